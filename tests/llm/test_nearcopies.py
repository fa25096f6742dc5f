"""Near copies against all pairs by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import core, nearcopies
from tests.llm.conftest import table_of


def grams(text, n=3):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.5):
    """{doc_id: least id of its component} of those in a group."""
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and grams(t):
            sets.setdefault(i, grams(t))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 2 * min(len(x), len(y)) >= max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
                pairs.add((a, b))
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for p in pairs for i in p}, pairs


def varied(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def corpus(n_groups=12, size=9, hot=500):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=rng.randrange(40, 300))
        texts += [" ".join(varied(rng, base, rng.choice([0, 0.02, 0.05, 0.1]))) for _ in range(size)]
    base = rng.choices(vocabulary, k=120)
    texts += [" ".join(varied(rng, base, 0.03)) for _ in range(hot)]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 200))) for _ in range(150)]
    rng.shuffle(texts)
    return texts


def test_recall_and_precision(spark):
    texts = corpus()
    got = {r.doc_id: r.group_id for r in nearcopies.groups(table_of(spark, texts)).collect()}
    want, _ = brute([(i + 1, t) for i, t in enumerate(texts)])
    assert set(got) <= set(want)
    hits = sum(got.get(i) == g for i, g in want.items())
    assert hits >= 0.95 * len(want)


def test_documents_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.group_id for r in nearcopies.groups(docs).collect()}
    want, _ = brute(rows)
    assert set(got) <= set(want)
    assert sum(got.get(i) == g for i, g in want.items()) >= 0.95 * len(want)
    kept = {r.doc_id for r in nearcopies.one_of_each(spark, docs, small).select("doc_id").collect()}
    assert kept == {i for i, _ in rows} - {i for i, g in got.items() if i != g}


def test_all_links_between_different_texts(spark):
    texts = corpus(5, 6, 100)
    docs = table_of(spark, [*texts, *texts[:40]])
    _, want = brute([(i + 1, t) for i, t in enumerate(texts)])
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in nearcopies.pairs(docs).collect()}
    sets = {i + 1: grams(t) for i, t in enumerate(texts)}
    equal = {(a, b) for a, b in want if sets[a] == sets[b]}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {tuple(sorted((first[frozenset(sets[a])], first[frozenset(sets[b])]))) for a, b in want - equal}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    for (a, b), j in got.items():
        assert abs(j - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12
    links = {}
    for a, b in got:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    for r in nearcopies.keyed_groups(docs).collect():
        i = r.doc_id if r.doc_id <= len(texts) else r.doc_id - len(texts)
        assert r.links == links.get(first[frozenset(sets[i])], 0)
        assert r.copies == sum(s == sets[i] for s in sets.values()) - 1 + sum(sets[k + 1] == sets[i] for k in range(40))


def test_blocks_of_a_bucket_that_nothing_splits(spark, monkeypatch):
    """90 nearly equal sets stay together at every depth: blocks of them meet pair by pair."""
    monkeypatch.setattr(nearcopies, "HOT", 30)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(400)]
    texts = [" ".join(varied(rng, base, 0.002)) for _ in range(90)]
    _, want = brute([(i + 1, t) for i, t in enumerate(texts)])
    sets = {i + 1: grams(t) for i, t in enumerate(texts)}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {tuple(sorted((first[frozenset(sets[a])], first[frozenset(sets[b])]))) for a, b in want if sets[a] != sets[b]}
    got = {(r.doc_id_a, r.doc_id_b) for r in nearcopies.pairs(table_of(spark, texts)).collect()}
    assert got == want


def test_one_doc_id_with_two_texts(spark, tiny):
    t = " ".join(f"t{i}" for i in range(30))
    docs = table_of(spark, [(1, t), (2, t), (2, "another text that nothing resembles at all"), (3, t + " and"), (3, t + " and")])
    kept = sorted((r.doc_id, r.text) for r in nearcopies.one_of_each(spark, docs, tiny).collect())
    assert kept == [(1, t), (2, "another text that nothing resembles at all")]


def test_odd_rows(spark, odd, none, tiny):
    got = nearcopies.groups(odd).collect()
    assert not [r for r in got if r.doc_id in (None, 9001, 9002, 9003)]
    kept = nearcopies.one_of_each(spark, odd, tiny)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 9006").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert nearcopies.groups(none).count() == 0 and nearcopies.one_of_each(spark, none, tiny).count() == 0
    same = nearcopies.groups(table_of(spark, ["a b c d", "A B c D", "other words are here", "x"])).collect()
    assert sorted((r.doc_id, r.group_id) for r in same) == [(1, 1), (2, 1)]


def test_hot_buckets_are_split_as_tables(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 40)
    texts = corpus(4, 6, 120)
    got = {r.doc_id: r.group_id for r in nearcopies.groups(table_of(spark, texts)).collect()}
    want, _ = brute([(i + 1, t) for i, t in enumerate(texts)])
    assert set(got) <= set(want) and sum(got.get(i) == g for i, g in want.items()) >= 0.9 * len(want)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in nearcopies.components(edges).collect()} == {1}


def test_links_of_a_large_group_are_never_rows(spark, monkeypatch):
    """300 different texts, any two of them alike: every link counts, but no table grows with their number."""
    monkeypatch.setattr(nearcopies, "BLOCK", 70)
    rng, written, table = random.Random(5), [], core.table
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join(varied(rng, base, 0.01)) + f" own{k}" for k in range(300)]

    def counted(df, *more):
        out = table(df, *more)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(core, "table", counted)
    got = nearcopies.keyed_groups(table_of(spark, texts)).collect()
    _, pairs = brute([(i + 1, t) for i, t in enumerate(texts)])
    links = {}
    for p in pairs:
        for i in p:
            links[i] = links.get(i, 0) + 1
    assert len(pairs) > 40000 and {r.doc_id: r.links for r in got} == links
    assert max(written) <= 20 * len(texts)


def test_overlaps_and_forest():
    rng = np.random.default_rng(2)
    x, y = ([np.unique(np.concatenate([rng.integers(0, 60, 20), rng.integers(0, 10**6, 50)])).astype(np.uint64) for _ in range(n)] for n in (150, 90))
    want = np.array([[len(np.intersect1d(a, b)) for b in y] for a in x])
    assert (nearcopies.overlaps(x, y) == want).all()
    ok = rng.random((40, 50)) < 0.02
    a, b = nearcopies.forest(ok, np.arange(40), 40 + np.arange(50))
    assert all(ok[i, k - 40] for i, k in zip(a, b))

    def label(one, two):
        up = np.arange(90)
        for _ in range(90):
            for i, k in zip(one, two):
                up[i] = up[k] = min(up[i], up[k])
        return up

    i, k = np.nonzero(ok)
    assert (label(a, b) == label(i, k + 40)).all()


def test_texts_that_stay_are_not_shuffled(spark, tiny, monkeypatch):
    """Of 40 texts one goes, and its group's few rows are all that the join with the rows to drop reads."""
    gone = spark.createDataFrame([(2, 1, 7)], "doc_id bigint, group_id bigint, group_key bigint")
    docs = table_of(spark, [" ".join(f"w{k}x{i}" for i in range(50)) for k in range(40)])
    keys = {r.doc_id: r.k for r in docs.select("doc_id", core.row_key().alias("k")).collect()}
    monkeypatch.setattr(nearcopies, "keyed_groups", lambda d: gone.withColumn("row_key", F.lit(keys[2])))
    out = nearcopies.one_of_each(spark, docs, tiny)
    assert {r.doc_id for r in out.collect()} == set(keys) - {2}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join LeftAnti") and "there(" in plan[plan.index("Join LeftAnti"):]
