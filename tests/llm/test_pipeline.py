"""The pipeline's stages against brute force, each on its own input, and the registry."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from auditlake.llm import langid, nearcopies, packing, quality, queries, repeats, subwords
from tests.llm import test_langid, test_nearcopies, test_packing, test_repeats


def test_stages_one_after_another(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "substring dedup", "packing"]
    columns, tables = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
    first, one, two, three, four = tables
    text = lambda d: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    # quality and language: the kept rows are those that the same model keeps, one row at a time
    model, rows = quality.fit(first, labels), sorted(text(first).items())
    import pyarrow as pa

    want = set()
    for i, t in rows:
        q, tox = model.scores(pa.array([t]))
        if q[0] >= quality.MIN_QUALITY and tox[0] < quality.MAX_TOXIC:
            want.add(i)
    assert set(text(one)) == want
    coder = langid.fit(one)
    assert set(text(two)) == {i for i, t in text(one).items() if coder.verdict(pa.array([t]))[3][0]}
    # near copies: one of each group stays
    groups, _ = test_nearcopies.brute(text(two).items())
    assert len(set(text(three)) ^ (set(text(two)) - {i for i, g in groups.items() if i != g})) <= 0.05 * max(1, len(groups))
    # repeats: the words that are left
    cut, left = test_repeats.brute(text(three).items()), text(four)
    for i, t in text(three).items():
        w = [x for k, x in enumerate(t.split()) if k not in cut.get(i, ())]
        assert left.get(i, "").split() == w
    sequences, tokens = test_packing.check(docs.collect(), left, packing.CAPACITY)
    assert tokens <= sequences * packing.CAPACITY


def test_run_and_registry(spark, tiny):
    assert queries.QUERIES["pipeline"](spark, tiny).columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 10 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_through_all_stages(spark, odd, none, tiny):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, tiny).collect(), stage(spark, docs, tiny).schema)
    assert docs.columns[0] == "doc_id"
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.count() == 0


def test_workers_hold_arrays_of_a_small_part_of_a_batch():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(3000)])
    ids = pa.array(np.arange(len(texts)))
    assert texts.nbytes > 6e6

    def drained(batches):
        for _ in batches:
            pass

    encoder = subwords.shared()
    for kernel, most in (
        (lambda: quality.stat_matrix(texts, np.arange(9, dtype=np.uint64)), 30),
        (lambda: drained(nearcopies.sketches([pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "row_key", "text"])], 0.5, 0.95)), 30),
        (lambda: drained(repeats.anchors([pa.RecordBatch.from_arrays([ids, texts], ["key", "text"])])), 30),
        (lambda: encoder.counts(texts), 40),
    ):
        assert test_langid.peak_mb(kernel) < most
