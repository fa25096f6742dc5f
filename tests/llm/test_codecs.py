"""Exact round trips: rANS blocks, merge-dropout segmentation, subword ids by chunks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import dropout, rans, subwords


def test_blocks_decode_to_their_ids_whole_and_from_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 2 * rans.BLOCK + 777):
        ids = np.minimum(rng.geometric(0.01, n), 50_000)
        freq = rans.scaled(np.bincount(ids, minlength=subwords.VOCABULARY))
        assert n == 0 or freq.sum() == 1 << rans.SCALE
        decode, blocks = rans.decoder(freq), rans.encode(ids, freq)
        assert np.array_equal(np.concatenate([decode(b) for b in blocks] or [np.zeros(0)]), ids)
        for b in blocks:
            whole, steps = decode(b), [0, *[p["step"] for p in b["checkpoints"]], -(-b["n_ids"] // rans.LANES)]
            parts = [decode(b, a, z) for a, z in zip(steps, steps[1:])]
            assert np.array_equal(np.concatenate(parts)[: len(whole)], whole)
    bits = sum(len(b["payload"]) * 8 for b in blocks) / n
    p = np.bincount(ids) / n
    assert bits < 1.02 * -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.2


def test_damage_is_found():
    ids = np.arange(5000) % 300
    freq = rans.scaled(np.bincount(ids, minlength=subwords.VOCABULARY))
    b = rans.encode(ids, freq)[0]
    raw = bytearray(b["payload"])
    raw[100] ^= 1
    with pytest.raises(ValueError):
        rans.decoder(freq)(b | {"payload": bytes(raw)})


def test_scaling_rare_and_common_ids():
    counts = np.ones(subwords.VOCABULARY, np.int64)
    counts[7] = 10**12
    f = rans.scaled(counts)
    assert f.sum() == 1 << rans.SCALE and f.min() == 1


def whole_ids(texts):
    bpe = subwords.encoder()
    return [bpe.encode_ordinary(t) for t in texts]


def test_corpus_round_trip(spark, odd, none):
    blocks = rans.encode_corpus(odd.repartition(3))
    parts = rans.decode_corpus(blocks).orderBy("doc_id", "first_id").collect()
    want = odd.where("text IS NOT NULL").select("doc_id", "text").collect()
    got = {}
    for p in parts:
        got.setdefault(p.doc_id, []).extend(p.ids)
    ids = {}
    for r in want:
        ids.setdefault(r.doc_id, []).extend(whole_ids([r.text])[0])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}
    assert [r.shard for r in rans.encode_corpus(none).collect()] == [-1]


def test_chunked_ids_equal_whole_ones(spark, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", "a  b\n\nc", " é ü x", "日本語 text", "it's we'll  12 3a!", "\n", "a\n", "tab\tb", "x \n y"]
    for _, _, ids, first in subwords.shared().slices(pa.array(texts)):
        assert [ids[a:z].tolist() for a, z in zip(first, first[1:])] == whole_ids(texts)
    assert subwords.shared().counts(pa.array(texts)).tolist() == [len(x) for x in whole_ids(texts)]


def test_dropout_decodes_and_varies(spark, odd, none):
    d = odd.where("doc_id IS NOT NULL")
    ids = dropout.encode(d, 0.1, 1)
    back = dropout.decode(ids).collect()
    assert sorted((r.doc_id, r.text or "") for r in back) == sorted((r.doc_id, r.text or "") for r in d.collect())
    assert [r.ids for r in ids.where("doc_id = 9001").collect()] == [None] and [r.ids for r in ids.where("doc_id = 9002").collect()] == [[]]
    a, b, c = ({r.doc_id: r.ids for r in dropout.encode(d, 0.1, s).where("doc_id < 9000").collect()} for s in (1, 2, 1))
    assert a == c and sum(a[k] != b[k] for k in a) > 0.8 * len(a)
    assert dropout.encode(none).count() == 0 and dropout.encode(odd).count() == odd.count()


def test_rate_zero_is_the_models_own_segmentation(spark, tiny):
    import os

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(subwords.TOKENIZERS, dropout.MODEL_FILE))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("text <> ''")
    got = {r.doc_id: r.ids for r in dropout.encode(docs, 0.0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = [i for i, t in texts.items() if "  " not in t and t == t.strip()]
    same = sum(got[i] == sp.encode(texts[i]) for i in plain)
    assert len(plain) > 50 and same >= 0.98 * len(plain)


def test_long_and_short_chunks_follow_the_same_agenda(monkeypatch):
    p = dropout.pieces(subwords.TOKENIZERS)
    texts = ["internationalization" * 2 + " of considerable misunderstandings", "Donaudampfschifffahrtsgesellschaft ab"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for rate in (0.0, 0.2, 1.0):
        monkeypatch.setattr(dropout, "WIDE", 60)
        a = dropout.encode_slice(p, buf, off, np.array([4, 5]), rate, 9)
        monkeypatch.setattr(dropout, "WIDE", 1)
        b = dropout.encode_slice(p, buf, off, np.array([4, 5]), rate, 9)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert len(a[0]) == sum(map(len, texts)) + 2  # every merge skipped: characters, and a blank before each text


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "some words here")], "doc_id bigint, text string")
    assert dropout.decode(dropout.encode(d)).head().text == "some words here"
    assert rans.decode_corpus(rans.encode_corpus(d)).select(F.size("ids")).head()[0] == len(whole_ids(["some words here"])[0])


def test_invalid_utf8_is_replaced(spark):
    """Bytes that aren't UTF-8 count as U+FFFD in every operator that reads characters, and crash none."""
    from auditlake.llm import dropout, lm, packing

    d = spark.sql("SELECT 1L doc_id, cast(X'6120FF6220E2' AS string) text UNION ALL SELECT 2L, 'a b' UNION ALL SELECT 3L, decode(X'6120EFBFBD6220EFBFBD', 'utf-8')")
    ids = {r.doc_id: r.ids for r in dropout.encode(d, rate=0.0).collect()}
    assert ids[1] != ids[2] and {r.doc_id: r.text for r in dropout.decode(dropout.encode(d)).collect()} == {1: "a �b �", 2: "a b", 3: "a �b �"}
    parts = {r.doc_id: r.ids for r in rans.decode_corpus(rans.encode_corpus(d)).collect()}
    assert parts[1] == parts[3] and lm.score(d).count() == 3
    assert {r.doc_id: r.n_tokens for r in packing.pack(d).collect()} == {k: len(v) for k, v in parts.items()}
