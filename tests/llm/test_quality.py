"""Quality rules against tree walks one node at a time, monotone constraints, held-out labels and odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.llm import quality


def data(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    y = (x[:, 0] + 0.5 * np.sin(6 * x[:, 1]) + 0.2 * rng.standard_normal(n) > 0.7).astype(float)
    return x, y


def test_flat_arrays_score_as_a_walk_does():
    x, y = data()
    t = quality.fit_trees(x, y, {}, rounds=12)
    raw = np.full(50, t.base)
    for i in range(50):
        for root in t.roots:
            k = root
            while t.left[k] != k:
                k = t.left[k] if x[i, t.feature[k]] <= t.threshold[k] else t.right[k]
            raw[i] += t.value[k]
    assert np.allclose(t.score(x[:50]), 1 / (1 + np.exp(-raw)))


def test_monotone_constraint_holds_everywhere_and_costs_little():
    x, y = data()
    free, bound = quality.fit_trees(x, y, {}), quality.fit_trees(x, y, {0: 1, 1: -1})
    rng = np.random.default_rng(1)
    for f, sign in ((0, 1), (1, -1)):
        z = np.repeat(rng.random((200, 4)), 40, 0)
        z[:, f] = np.tile(np.linspace(-0.2, 1.2, 40), 200)
        s = bound.score(z).reshape(200, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert ((free.score(x) > 0.5) == y).mean() > 0.85


def test_statistics_of_texts():
    texts = pa.array(["Aa 12 $$ aa", None, "", "x\nx\ny"])
    m = dict(zip(quality.FEATURES, quality.stat_matrix(texts, np.zeros(0, np.uint64)).T))
    assert m["digit_share"][0] == 2 / 11 and m["symbol_share"][0] == 2 / 11 and m["upper_share"][0] == 1 / 11
    assert m["top_word_share"][0] == 0.5 and m["distinct_word_share"][0] == 0.75
    assert abs(m["repeat_line_share"][3] - 1 / 3) < 1e-9 and m["log_words"][1] == 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, labels.where(half == 0))
    got = quality.score(docs.join(labels, "doc_id").where(half == 1), model, "m").select("quality", "toxic", "m.quality", "m.toxic", "lang").toDF("q", "t", "sq", "st", "lang").toPandas()
    assert len(got) > 100
    assert ((got.sq > 0.5) == (got.q == 1)).mean() > 0.85
    # the other languages' toxic rows of this table hardly share words: half of the labels can't show them
    assert got.st[(got.t == 1) & (got.lang == "en")].gt(0.5).mean() > 0.85 and got.st[got.t == 1].gt(0.5).mean() > 0.7 and got.st[got.t == 0].gt(0.5).mean() < 0.02


def test_odd_rows(spark, odd, none, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality.fit(odd, labels)
    got = quality.score(odd.select("doc_id", "text"), model, "m").select("doc_id", "text", "m.*").collect()
    assert len(got) == odd.count()
    assert all(r.quality == 0 and r.toxic == 0 for r in got if r.text is None or not r.text.strip())
    kept = quality.kept(spark, odd, tiny)
    assert kept.columns == odd.columns and not kept.where("text IS NULL OR trim(text) = ''").count()
    assert quality.kept(spark, none, tiny).count() == 0
    no_labels = quality.fit(odd, labels.limit(0))
    assert quality.score(odd, no_labels, "m").where("text <> '' AND trim(text) <> '' AND m.quality < 0.9 AND length(text) > 5 AND doc_id <> 9003").count() == 0


def test_lexicon_has_every_pure_word(spark):
    toxic = [f"plain filler bad{w:03d}x end" for w in range(150) for _ in range(8)]
    rows = spark.createDataFrame([(t, 1) for t in toxic] + [("plain filler end", 0)] * 400, "text string, t int")
    words = [f"bad{w:03d}x" for w in range(150)]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    own = next(quality._lexical(buf, ends - len(words[0]), ends))[1]
    assert np.isin(own, quality._lexicon(rows)).all()


def test_held_out_toxic_rows_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fifth = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    model = quality.fit(docs, labels.where(fifth != 0))
    got = quality.score(docs.join(labels.where(fifth == 0), "doc_id"), model, "m").select("toxic", "m.toxic", "lang").toDF("t", "st", "lang").toPandas()
    recall = got[got.t == 1].groupby("lang").st.agg(lambda s: s.gt(0.5).mean())
    assert recall.min() > 0.6 and got.st[got.t == 1].gt(0.5).mean() > 0.95 and got.st[got.t == 0].gt(0.5).mean() < 0.02
