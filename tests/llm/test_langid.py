"""Language ID against a dictionary model that escapes byte by byte, held-out labels and odd rows."""

import math
import pickle
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.llm import core, langid


def brute(texts: list[str], probe: str) -> float:
    """Code length of probe in bits, straight from the definition."""
    trees = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(i, langid.ORDER) + 1):
                trees[b[i - k : i]][b[i]] += 1
    bits, b = 0.0, probe.encode()
    for i in range(len(b)):
        for k in range(min(i, langid.ORDER), -1, -1):
            c = trees.get(b[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                bits -= math.log2(c[b[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_definition():
    a, b = ["the cat sat on the mat", "that hat"], ["die katze sass", "der hut dort", "ab"]
    coder = langid.build({"en": a, "de": b})
    assert coder.languages == ["de", "en"]
    probes = ["the hat", "der dort zzz", "a", "", "xyzxyzxyz", "thé ü cat"]
    bits, size = coder.score(pa.array(probes))
    for k, p in enumerate(probes):
        assert size[k] == len(p.encode())
        assert np.allclose(bits[k], [brute(b, p), brute(a, p)], rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    coder = langid.fit(docs.where(half == 0), 60)
    got = langid.score(docs.where((half == 1) & (F.length("text") > 100)), coder, "v").select("lang", "v.lang", "v.keep").toDF("lang", "is", "keep").toPandas()
    assert len(got) > 300
    assert (got["is"] == got.lang).mean() > 0.93
    assert got.keep.mean() > 0.8
    noise = pa.array(["".join(chr(33 + (i * i * 31 + i * 7 + k) % 90) for i in range(400)) for k in range(5)])
    assert not coder.verdict(noise)[3].any()


def test_odd_rows(spark, odd, none, tiny):
    kept = langid.kept(spark, odd, tiny)
    assert kept.columns == odd.columns and not kept.where("text IS NULL OR text = ''").count()
    assert kept.where("doc_id = 9006").count() in (0, 2)
    assert langid.kept(spark, none, tiny).count() == 0
    assert langid.kept(spark, odd.withColumn("lang", F.lit(None).cast("string")), tiny).count() == 0


def test_hash_table_finds_what_it_holds():
    keys = core.mix(np.arange(5000, dtype=np.uint64)) >> np.uint64(3)
    t = langid.Table(keys, np.arange(5000, dtype=float)[:, None])
    at = t.find(keys)
    assert (at >= 0).all() and (t.values[at, 0] == np.arange(5000)).all()
    assert (t.find(core.mix(np.arange(9000, 9100, dtype=np.uint64)) >> np.uint64(3)) == -1).all()


def test_every_labelled_row_counts(spark):
    """More rows than any bounded sample: the trees have all bytes of both folds, and the limit is the quantile of all rows."""
    rows = [(i, f"{'the' if i % 2 else 'der'} text {i} {i * i} ends", "en" if i % 2 else "de") for i in range(6000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = pa.array([t for _, t, _ in rows])
    fold = langid.folds_of(texts)
    assert 2500 < fold.sum() < 3500
    for k in (0, 1):
        want = langid.build({x: [t for (_, t, n), f in zip(rows, fold) if n == x and f == k] for x in ("de", "en")})
        probe = texts.slice(100, 50)
        assert np.allclose(model.coders[k].score(probe)[0], want.score(probe)[0])
    bits, size = model.score(texts)
    assert np.isclose(model.bits_limit, langid.SLACK * np.quantile(np.maximum(bits.min(1) - langid.ALLOWANCE, 0) / size, 0.999))
    assert (model.verdict(texts)[0] == np.array([i % 2 for i in range(6000)])).all()


def test_trees_over_their_bound_lose_the_rarest_grams(spark, small, monkeypatch):
    monkeypatch.setattr(langid, "GRAMS", 20000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.score(docs.where("length(text) > 100"), langid.fit(docs), "v").selectExpr("avg(int(v.lang = lang)) AS x").first().x
    assert got > 0.93


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        kept = f()  # noqa: F841
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little_besides_the_grams():
    """Of four languages: 24 bytes a gram in all, slots, and arrays of a part of the batch."""
    keys = core.mix(np.arange(1 << 20, dtype=np.uint64)) >> np.uint64(3)
    sent = pickle.dumps(langid.Table(keys, np.zeros((len(keys), 4), np.float32)))
    assert peak_mb(lambda: pickle.loads(sent)) < 24 * 1.05 + 4 * 4.2 + 20
    words = "the cat der hut la casa un chat".split()
    texts = [" ".join(words[(i * 7 + k * k) % len(words)] for k in range(200)) for i in range(4000)]
    model = langid.Folds([langid.build({x: texts[k::8] for k, x in enumerate(["de", "en", "es", "fr"])})] * 2)
    batch = pa.array(texts)
    assert batch.nbytes > 3e6 and peak_mb(lambda: model.score(batch)) < 60
