"""Shared pieces of the corpus operators: lineage cuts, Arrow text access, vectorised hashing.

Every numpy kernel here works on the raw UTF-8 bytes of an Arrow batch and is fed in
slices of at most ``SLICE_BYTES`` so that a worker's memory doesn't depend on how long
single documents are (a single longer document forms a slice of its own).
"""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


# --- lineage -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local session without one gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = java.get() if java.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables in the shared folder, oldest first, which some result may still read.
_tables: list[str] = []


def table(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    What no later step reads is dropped by ``drop_table``; a lazy result's own tables go by ``release``, or at the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditlake-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_release_all, spark)
    _tables.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by ``table`` that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _tables:
            _tables.remove(path)


def mark() -> int:
    """Where the list of tables stands; ``release`` takes it."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Drop all tables made after ``mark`` gave ``since``: call it once the results that read them are written."""
    drop_table(spark, *[p for p in _tables[since:] if p not in keep])


def _release_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


def whole_utf8(buf: np.ndarray) -> bytes:
    """The bytes, with U+FFFD for what isn't UTF-8 (as Python's "replace" has it): so do all operators that read characters."""
    raw = buf.tobytes()
    return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()


def valid_utf8(arr: pa.Array) -> pa.Array:
    """Texts whose invalid UTF-8 is replaced by U+FFFD, row by row where there is any; valid arrays come back as they are."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    try:
        arr.cast(pa.binary() if arr.type == pa.string() else pa.large_binary()).cast(arr.type)
        return arr
    except pa.ArrowInvalid:
        raw = arr.cast(pa.large_binary())
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def row_key(text: str = "text"):
    """Tells the rows of one doc_id apart by their texts: 64 bits, which are only ever compared within a doc_id."""
    return F.xxhash64(F.col(text).cast("string"))


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (bigint) and text: whatever else the table holds can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_auditlake_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="auditlake-py-")) / "auditlake.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((root / "auditlake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(at))
    sc._auditlake_shipped = True


# --- Arrow -------------------------------------------------------------------


def trim() -> None:
    """Give a worker's free memory back, so that idle workers don't keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and os.path.exists("/lib/x86_64-linux-gnu/libc.so.6") else None
if _LIBC is not None:  # numpy's temporaries come from the heap, not from fresh pages each; ``trim`` gives free memory back
    _LIBC.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
    _LIBC.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def slices(arr: pa.Array, limit: int = SLICE_BYTES):
    """(first row, rows, bytes, offsets) of consecutive slices; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        o = offsets[at : to + 1]
        yield at, to - at, raw[o[0] : o[-1]], o - o[0]
        at = to
    trim()


# --- hashing -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW = np.ones(4096, np.uint64)
for _i in range(1, 4096):
    _POW[_i] = (int(_POW[_i - 1]) * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[s:e] for sorted, disjoint spans."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    if total == 0:
        return mix(np.zeros(len(starts), np.uint64))
    first = np.cumsum(lens) - lens
    within = np.arange(total) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    val = _BYTE[buf[at]] * _POW[within & 4095]
    if total > 0 and int(lens.max()) > 4096:
        val += mix((within >> 12).astype(np.uint64)) * np.uint64(31)
    sums = np.zeros(len(starts), np.uint64)
    some = lens > 0
    sums[some] = np.add.reduceat(val, first[some])
    return mix(sums ^ (lens.astype(np.uint64) << np.uint64(48)))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row plus the total) of the words that ASCII white space delimits."""
    n = len(buf)
    ws = _WS[buf]
    edge = np.zeros(n + 1, bool)
    inner = offsets[(offsets >= 0) & (offsets <= n)]
    edge[inner] = True
    prev = np.ones(n, bool)
    if n:
        prev[1:] = ws[:-1]
        prev |= edge[:n]
    starts = np.flatnonzero(~ws & prev)
    nxt = np.ones(n, bool)
    if n:
        nxt[:-1] = ws[1:]
        nxt |= edge[1 : n + 1]
    ends = np.flatnonzero(~ws & nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(values: np.ndarray, first: np.ndarray, op=np.add, empty=0):
    """Reduce the items of each row; rows without items get ``empty``."""
    lens = np.diff(first)
    out = np.full(len(lens), empty, values.dtype)
    some = lens > 0
    if some.any():
        out[some] = op.reduceat(values, first[:-1][some])
    return out


def ngram_hashes(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams (a shorter row has one: all its words) and the rows' first n-grams."""
    lens = np.diff(first)
    count = np.where(lens >= n, lens - n + 1, (lens > 0).astype(lens.dtype))
    out_first = np.concatenate([[0], np.cumsum(count)])
    if out_first[-1] == 0:
        return np.zeros(0, np.uint64), out_first
    start = np.arange(out_first[-1]) - np.repeat(out_first[:-1], count) + np.repeat(first[:-1], count)
    stop = np.repeat(first[1:], count)
    acc = np.zeros(len(start), np.uint64)
    for j in range(n):
        at = start + j
        inside = at < stop
        h = np.where(inside, word_hash[np.minimum(at, len(word_hash) - 1)], np.uint64(0x1234567))
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h)
    return acc, out_first


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind), mask=mask)


# --- a filter of bounded size --------------------------------------------------

#: A Bloom filter has 16 bits an entry up to this many bits (32 MB); with more entries it lets more through, and what follows it decides alone.
FILTER_BITS = 1 << 28
_SHIFTS = (0, 18, 36)


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of a table's one column of well-mixed bigints, set by a distributed aggregate of at most FILTER_BITS / 64 rows."""
    x = hashes.columns[0]
    n = hashes.count()
    bits = 1 << 10
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    spots = hashes.select(F.explode(F.array(*[F.shiftrightunsigned(x, s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS])).alias("b"))
    got = spots.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint64)


def may_hold(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether hashes may be among the filter's; never false for one that is."""
    x, last, hit = x.view(np.uint64), np.uint64(64 * len(filter_) - 1), np.ones(len(x), bool)
    for s in _SHIFTS:
        b = (x >> np.uint64(s)) & last
        hit &= (filter_[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0
    return hit


def one_of_equal_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and text; rows with a null doc_id all stay.  Only rows that occur twice are shuffled, summed up before."""
    spark = docs.sparkSession
    key = [F.col("doc_id").cast("long").alias("__al_id"), row_key().alias("__al_key")]
    often, path = table(docs.where("doc_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("__al_n")).where("__al_n > 1").select("__al_id", "__al_key"))
    if not often.limit(1).count():
        drop_table(spark, path)
        return docs
    on = (F.col("doc_id").cast("long") == F.col("__al_id")) & (row_key() == F.col("__al_key"))
    twice = docs.join(often, on, "left_semi").select("*", *key)
    return docs.join(often, on, "left_anti").unionByName(twice.dropDuplicates(["__al_id", "__al_key"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
