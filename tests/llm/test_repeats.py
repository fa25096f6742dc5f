"""Repeats against a table of all windows."""

import random

import numpy as np

from auditlake.llm import repeats
from tests.llm.conftest import table_of

L = repeats.LEAST


def brute(rows):
    """{doc_id: set of word numbers that belong to a run of L words standing at an earlier place}"""
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        w = [x for x in t.encode().split() if x]
        for p in range(len(w) - L + 1):
            key = tuple(w[p : p + L])
            if key in seen:
                out.setdefault(i, set()).update(range(p, p + L))
            else:
                seen[key] = (i, p)
    return out


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(600)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300, 700)]
    texts = []
    for _ in range(90):
        t = [word() for _ in range(rng.randrange(5, 250))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(t) + 1)
            cut = rng.randrange(0, len(p) // 3) if rng.random() < 0.4 else 0
            t[at:at] = p[cut:]
        texts.append(rng.choice([" ", "  ", "\n"]).join(t))
    texts += ["la " * 200, "so on " * 100, " ".join(passages[4] * 3), texts[0], texts[0]]
    return texts


def test_all_repeats_and_no_others(spark):
    texts = corpus()
    got = repeats.repeats(table_of(spark, texts)).collect()
    assert covered(got) == brute([(i + 1, t) for i, t in enumerate(texts)])
    words = {i + 1: t.split() for i, t in enumerate(texts)}
    for r in got:  # the named source holds the longest piece of the interval
        assert (r.source_id, r.source_word) < (r.doc_id, r.first_word + r.n_words)
        assert any(words[r.source_id][r.source_word : r.source_word + L] == words[r.doc_id][k : k + L] for k in range(r.first_word, r.first_word + r.n_words - L + 1))


def test_documents_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert covered(repeats.repeats(docs).collect()) == brute(rows)


def test_cuts_take_effect(spark, tiny):
    rng = random.Random(1)
    p = " ".join(f"p{i}" for i in range(60))
    texts = [f"start {p} end", f"new {p}\nrest of it", p, " ".join(f"q{rng.random()}" for _ in range(80))]
    got = {r.doc_id: r for r in repeats.without_repeats(spark, table_of(spark, texts), tiny).collect()}
    assert got[1].text == texts[0] and got[4].text == texts[3]
    assert got[2].text == "new rest of it" and got[2].n_chars == len("new rest of it")
    assert 3 not in got


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    fm = repeats.FMIndex(text)
    s = text.tolist()
    for n in (1, 2, 5):
        for _ in range(20):
            p = rng.integers(1, 5, n)
            lo, hi = np.array([0]), np.array([len(text)])
            for c in p[::-1]:
                lo, hi = fm.step(np.array([c]), lo, hi)
            at = [i for i in range(len(s) - n + 1) if s[i : i + n] == p.tolist()]
            assert hi[0] - lo[0] == len(at)


def test_contexts_are_the_windows():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 3, 300), 0)
    for depth in (1, 3, 7):
        order, new = repeats.contexts(text, depth)
        keys = [tuple(text[i : i + depth]) for i in order]
        assert keys == sorted(keys) and new.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def test_hot_owners(spark, monkeypatch):
    """Every owner is hot: windows that an owner has once are left out, equal runs are indexed once, and the result is the same."""
    monkeypatch.setattr(repeats, "SHARD_WORDS", 100)
    texts = corpus()
    got = repeats.repeats(table_of(spark, texts)).collect()
    assert covered(got) == brute([(i + 1, t) for i, t in enumerate(texts)])


def test_one_doc_id_with_two_texts(spark, tiny):
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(200))
    docs = table_of(spark, [(1, f"a {p} b"), (2, f"c {p} d"), (2, q), (3, q), (3, q)])
    left = sorted((r.doc_id, r.text) for r in repeats.without_repeats(spark, docs, tiny).collect())
    assert left == [(1, f"a {p} b"), (2, "c d"), (2, q)]


def test_a_hot_passage_and_a_very_long_text(spark):
    rng = random.Random(9)
    p = [f"p{i}" for i in range(70)]
    texts = [" ".join([f"u{rng.random()}" for _ in range(20)] + p + [f"u{rng.random()}" for _ in range(20)]) for _ in range(300)]
    long = [f"w{rng.randrange(50)}" for _ in range(9000)]
    texts += [" ".join(long), " ".join(long[100:8000] + p), "bad " + p[0]]
    got = covered(repeats.repeats(table_of(spark, texts)).collect())
    assert got == brute([(i + 1, t) for i, t in enumerate(texts)])


def test_odd_rows(spark, odd, none, tiny):
    got = covered(repeats.repeats(odd).collect())
    assert got[9006] == set(range(1, 60)) or got[9006] == set(range(60)) - set(range(0, 1))
    left = repeats.without_repeats(spark, odd, tiny)
    assert left.columns == odd.columns and left.where("doc_id IS NULL").count() == 2
    assert repeats.repeats(none).count() == 0 and repeats.without_repeats(spark, none, tiny).count() == 0
