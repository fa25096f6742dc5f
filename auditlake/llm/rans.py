"""Token ids as binary blocks: static range asymmetric numeral systems.

Texts become subword ids once (a written table); the ids of the whole corpus are counted and the
counts scaled to ``1 << SCALE`` in one frequency table that all blocks share.  A block holds up
to ``BLOCK`` consecutive ids of one shard in ``LANES`` interleaved 64-bit states that share one stream
of 32-bit words, so blocks decode independently and the lanes of many blocks advance together in
numpy.  Every ``CHECK`` steps a checkpoint keeps the states, the stream position and a CRC-32 of the
ids since the one before, so the parts of a block can be decoded in parallel, too; a CRC-32 covers the block.

Result rows: one header (shard -1) whose payload is the frequency table, then one row for each
block: the documents that it holds parts of (doc_ids, the first id of each part in its document, ids in the part).

Defined results: what isn't UTF-8 in a text is encoded as U+FFFD; null texts are in no block; an empty text is a part of 0 ids; repeated rows are
encoded once each; a null doc_id stays null in doc_ids; an empty table gives the header alone; extra columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import core, subwords

SCALE, LANES, BLOCK, CHECK = 20, 64, 1 << 15, 128
LOW = np.uint64(1 << 31)
_S, _W = np.uint64(SCALE), np.uint64(32)
SCHEMA = "shard int, block bigint, doc_ids array<bigint>, first_ids array<bigint>, counts array<int>, n_ids bigint, n_words int, states binary, payload binary, checkpoints array<struct<step:int,word:int,states:binary,crc:bigint>>, crc bigint"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to counts, at least 1 where there is any, that sum to 1 << SCALE."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts * float(1 << SCALE) / total), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = (1 << SCALE) - int(f.sum())
    if spare > 0:
        f[order[0]] += spare
    while spare < 0:  # take from those that have most
        big = order[f[order] > 1]
        take = np.minimum(f[big] - 1, np.maximum(1, f[big] * -spare // max(1, int(f[big].sum()))))
        take = np.where(np.cumsum(take) <= -spare, take, 0)
        f[big] -= take
        spare += int(take.sum())
    return f


def encode(ids: np.ndarray, freq: np.ndarray) -> list[dict]:
    """Blocks of consecutive ids; all blocks advance together."""
    n = len(ids)
    if n == 0:
        return []
    blocks = -(-n // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    padded = np.zeros(blocks * steps * LANES, np.int64)
    valid = np.zeros(len(padded), bool)
    padded[:n], valid[:n] = ids, True  # steps * LANES == BLOCK if there is more than one block
    sym = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    ok = np.ascontiguousarray(valid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    f_of = freq.astype(np.uint64)
    c_of = (np.cumsum(freq) - freq).astype(np.uint64)
    x = np.full(blocks * LANES, LOW)
    out, took = np.zeros((steps, blocks * LANES), np.uint32), np.zeros((steps, blocks * LANES), bool)
    marks = {}
    for t in range(steps - 1, -1, -1):
        s, v = sym[t], ok[t]
        whole = v.all()
        f, c = f_of[s], c_of[s]
        if not whole:
            f = np.where(v, f, 1)
        full = x >= f << np.uint64(63 - SCALE)
        if not whole:
            full &= v
        took[t] = full
        out[t] = x.astype(np.uint32)
        x = np.where(full, x >> _W, x)
        q = x // f
        new = (q << _S) + (x - q * f) + c
        x = new if whole else np.where(v, new, x)
        if t and t % CHECK == 0:
            marks[t] = x.copy()
    words = np.zeros(steps + 1, np.int64)
    result = []
    for b in range(blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        m = took[:, lanes]
        np.cumsum(m.sum(1), out=words[1:])
        part = ids[b * BLOCK : (b + 1) * BLOCK].astype(np.uint16)
        points = [{"step": t, "word": int(words[t]), "states": marks[t][lanes].tobytes(), "crc": zlib.crc32(part[(t - CHECK) * LANES : t * LANES].tobytes())} for t in sorted(marks) if t * LANES < len(part)]
        result.append({"n_ids": len(part), "n_words": int(words[-1]), "states": x[lanes].tobytes(), "payload": out[:, lanes][m].tobytes(), "checkpoints": points, "crc": zlib.crc32(part.tobytes())})
    return result


def decoder(freq: np.ndarray):
    """A function (block, first step, last step) -> ids, for whole blocks or from a checkpoint on; it verifies checksums."""
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    f_of = freq.astype(np.uint64)

    def decode(block: dict, begin: int = 0, end: int | None = None) -> np.ndarray:
        n = block["n_ids"]
        steps = -(-n // LANES)
        points = {p["step"]: p for p in block["checkpoints"]}
        start = points[begin] if begin else {"word": 0, "states": block["states"]}
        x, at = np.frombuffer(start["states"], np.uint64).copy(), start["word"]
        words = np.frombuffer(block["payload"], np.uint32)
        end = steps if end is None else end
        out = np.zeros((end - begin, LANES), np.uint16)
        for t in range(begin, end):
            live = min(LANES, n - t * LANES)
            y = x[:live]
            low = y & np.uint64((1 << SCALE) - 1)
            s = slot[low.astype(np.int64)]
            out[t - begin, :live] = s
            y = f_of[s] * (y >> _S) + low - cum[s]
            need = y < LOW
            k = int(need.sum())
            y[need] = y[need] << _W | words[at : at + k]
            at += k
            x[:live] = y
        ids = out.reshape(-1)[: n - begin * LANES]
        whole = begin == 0 and end == steps
        known = block["crc"] if whole else points[end]["crc"] if end in points and end - begin == CHECK else None
        if known is not None and zlib.crc32(ids.tobytes()) != known:
            raise ValueError("checksum mismatch")
        return ids

    return decode


# --- over documents --------------------------------------------------------------


def id_table(docs: DataFrame, tokenizers: str) -> tuple[DataFrame, str]:
    """(shard, seq, doc_ids, lens, ids as 16-bit binary) of each slice of texts, written once."""

    def tokenize(batches):
        enc, shard, seq = subwords.shared(tokenizers), TaskContext.get().partitionId(), 0
        for b in batches:
            doc_ids = b.column(0)
            for at, n, ids, first in enc.slices(b.column(1)):
                lens = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), core.list_array(np.zeros(0), np.array([0, 0]), pa.int64()) if n == 0 else pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), doc_ids.slice(at, n)), pa.array([lens.astype(np.int32)], pa.list_(pa.int32())), pa.array([ids.astype(np.uint16).tobytes()], pa.binary())],
                    ["shard", "seq", "doc_ids", "lens", "ids"],
                )
                seq += 1

    return core.table(core.id_text(docs).where("text IS NOT NULL").mapInArrow(tokenize, "shard int, seq int, doc_ids array<bigint>, lens array<int>, ids binary"))


def count_ids(ids: DataFrame) -> np.ndarray:
    """Counts of all ids of the corpus: summed in each task, then by a shuffle of at most one row a task and id."""

    def tally(batches):
        total = np.zeros(subwords.VOCABULARY, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    got = ids.select("ids").mapInArrow(tally, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(subwords.VOCABULARY, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def encode_corpus(docs: DataFrame, tokenizers: str = subwords.TOKENIZERS) -> DataFrame:
    spark = docs.sparkSession
    ids, _ = id_table(docs, tokenizers)
    counts = count_ids(ids)
    freq = scaled(counts)

    def blocks(batches):
        for b in batches:
            for shard, seq, doc_ids, lens, raw in zip(*b.columns):
                got = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
                lens, doc_ids = np.asarray(lens.values), doc_ids.values
                ends = np.cumsum(lens)
                starts = ends - lens
                encoded = encode(got, freq) or [{"n_ids": 0, "n_words": 0, "states": b"", "payload": b"", "checkpoints": [], "crc": 0}]
                for a in range(0, len(encoded), 64):
                    rows = []
                    for k, e in enumerate(encoded[a : a + 64], a):
                        lo, hi = k * BLOCK, k * BLOCK + e["n_ids"]
                        first = int(np.searchsorted(ends, lo, "left")) if k else 0
                        last = int(np.searchsorted(starts, hi, "left")) if k + 1 < len(encoded) else len(lens)
                        part = np.arange(first, last)
                        part = part[(ends[part] > lo) | (lens[part] == 0)]  # an empty text between two blocks belongs to the second
                        begin = np.maximum(starts[part], lo)
                        rows.append(e | {"shard": shard.as_py(), "block": (seq.as_py() << 32) + k, "doc_ids": doc_ids.take(pa.array(part)).to_pylist(), "first_ids": begin - starts[part], "counts": (np.minimum(ends[part], hi) - begin).astype(np.int32)})
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    header = [(-1, -1, [], [], [], int(counts.sum()), 0, b"", freq.astype(np.uint32).tobytes(), [], zlib.crc32(freq.astype(np.uint32).tobytes()))]
    return ids.mapInArrow(blocks, SCHEMA).unionByName(spark.createDataFrame(header, SCHEMA))


_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("n_words", pa.int32()), ("states", pa.binary()), ("payload", pa.binary()),
    ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int32()), ("states", pa.binary()), ("crc", pa.int64())]))), ("crc", pa.int64()),
])


def decode_corpus(blocks: DataFrame) -> DataFrame:
    """(doc_id, first_id, ids) of each part of each document; blocks decode independently."""
    table = blocks.where("shard = -1").select("payload").head()
    freq = np.frombuffer(table.payload, np.uint32).astype(np.int64)

    def run(batches):
        decode = decoder(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = decode(r)
                cuts = np.cumsum([0, *r["counts"]])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["first_ids"], pa.int64()), core.list_array(ids.astype(np.int32), cuts, pa.int32())], ["doc_id", "first_id", "ids"])

    return blocks.where("shard >= 0").mapInArrow(run, "doc_id bigint, first_id bigint, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
