"""Language ID: prediction by partial matching over bytes.

Each language gets a byte context tree of orders 0 to ``ORDER`` (counts n(context, byte), escape
method C: escape probability d / (n + d), d the distinct bytes seen after the context, order -1
uniform over 256 bytes, no exclusions).  The statistics are frozen after fitting, so the exact
code length of a byte depends on its longest context only: ``Coder`` folds the trees of all
languages into one hash table from (context, byte) to the vector of code lengths, escapes
included, and one from contexts to escape costs.  A text then costs one look-up per byte and
order tried, for all languages together.

All labelled rows are counted, in two folds by a hash of their bytes (equal texts share one): each
fold has trees of its own, and a text is scored by the other fold's, which haven't seen it.

A document is kept with the language of least total code length (ties: the first by name) if that
is at most ``bits_limit`` bits a byte plus ``ALLOWANCE`` bits a document.  The limit is set from
the scores of all labelled rows.

A fold's trees hold ``GRAMS`` grams at most, as each worker has them in memory: beyond that those of least count
are left out, all languages alike, and a byte is coded by its next shorter context.

Defined results: null and empty texts are rejected; repeated rows get equal results each; an empty table
gives an empty result, and so do documents without any non-null lang; null doc_ids are scored like any other; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core

ORDER = 4
#: Grams of a fold's trees at most, of all languages.
GRAMS = 1 << 21
SLACK, ALLOWANCE = 1.35, 64.0
#: Bytes of text, or keys, that a worker takes at once: its arrays are about 100 times that.
SLICE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open addressing from uint64 keys to rows of float32: slots hold numbers of keys, so that free ones take 4 bytes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5)))))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = keys, values.astype(np.float32, copy=False)
        self.slots = np.full(size, -1, np.int32)
        for a in range(0, len(keys), SLICE):
            slot = self._first(keys[a : a + SLICE])
            left = np.arange(a, a + len(slot), dtype=np.int32)
            while len(left):
                free = self.slots[slot] < 0
                self.slots[slot[free]] = left[free]
                lost = self.slots[slot] != left
                slot, left = (slot[lost] + 1) & self.mask, left[lost]

    def __getstate__(self):
        """Without its slots, which is what is broadcast."""
        return self.keys, self.values

    def __setstate__(self, state):
        self.__init__(*state)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``values``, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        slot = self._first(keys)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            slot[left] = s = (slot[left] + 1) & self.mask
            out[left] = at = self.slots[s]
            left = left[(at >= 0) & (self.keys[at] != keys[left])]
        return out


def grams(buf: np.ndarray, room: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (order + 1)-grams that end at each byte, and where the row has so many bytes."""
    g = buf.astype(np.uint64)
    for k in range(1, order + 1):
        g[k:] |= buf[:-k].astype(np.uint64) << np.uint64(8 * k) if k < len(buf) else 0
    return g | np.uint64(order + 1) << np.uint64(56), room >= order


def room(off: np.ndarray, n: int) -> np.ndarray:
    """Bytes of the same row before each byte, up to ORDER."""
    out = np.full(n, ORDER, np.int8)
    for k in range(ORDER):
        at = off[:-1] + k
        at = at[at < off[1:]]
        out[at] = k
    return out


@dataclass
class Coder:
    languages: list[str]
    symbols: Table
    contexts: Table
    bits_limit: float = 1e9

    def lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        n, m = len(buf), len(self.languages)
        cost = np.zeros((n + 1, m), np.float32)
        left, space = np.arange(n), room(off, n)
        last, _ = grams(buf, space, ORDER)
        for k in range(ORDER, -1, -1):
            key = last & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(k + 1) << np.uint64(56)
            ok = space >= k
            at = self.symbols.find(key)
            at[~ok] = -1
            hit = at >= 0
            if k == ORDER:
                cost[:n] = np.take(self.symbols.values, at, 0, mode="clip")
                cost[:n][~hit] = 0
            else:
                cost[left[hit]] += np.take(self.symbols.values, at[hit], 0)
            if k:
                esc = np.flatnonzero(ok & ~hit)
                c = self.contexts.find((key[esc] & np.uint64((1 << 56) - 1)) >> np.uint64(8) | np.uint64(k) << np.uint64(56))
                seen = c >= 0
                cost[left[esc[seen]]] += np.take(self.contexts.values, c[seen], 0)
            else:
                c = self.contexts.find(np.full(1, np.uint64(0) << np.uint64(56)))
                cost[left[~hit]] += self.contexts.values[c[0]] + 8.0
            more = np.flatnonzero(~hit)
            left, last, space = left[more], last[more], space[more]
            if not len(left):
                break
        begin, some = np.minimum(off[:-1], n), np.diff(off) > 0
        return np.stack([np.add.reduceat(x, begin, dtype=np.float64) for x in np.ascontiguousarray(cost.T)], 1) * some[:, None]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits under each language, bytes) of each text."""
        out, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, n, buf, off in core.slices(texts, SLICE):
            out[at : at + n] = self.lengths(buf, off)
            size[at : at + n] = np.diff(off)
        return out, size

    def verdict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best language's number, bits a byte, lead in bits over the next, kept) of each text."""
        if not self.languages:
            none = np.zeros(len(texts))
            return none.astype(int), none, none, none > 0
        bits, size = self.score(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        other = np.sort(bits, 1)[:, 1] if bits.shape[1] > 1 else least
        return best, least / np.maximum(size, 1), other - least, (size > 0) & (least <= self.bits_limit * size + ALLOWANCE)


Levels = list[tuple[np.ndarray, np.ndarray]]


def levels_of(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The grams of each order."""
    space = room(off, len(buf))
    return [g[ok] for g, ok in (grams(buf, space, k) for k in range(ORDER + 1))]


def build(texts: dict[str, list[str]]) -> Coder:
    """Freeze the context trees of these texts."""
    names = sorted(texts)
    per = []
    for name in names:
        got = [levels_of(buf, off) for _, _, buf, off in core.slices(pa.array(texts[name], pa.string()))]
        per.append([np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True) for x in (zip(*got) if got else [()] * (ORDER + 1))])
    return frozen(names, per)


def frozen(names: list[str], per: list[Levels]) -> Coder:
    """The coder of context trees that are given by each language's sorted grams of each order and their counts."""
    m = len(names)
    sym_keys, sym_vals, ctx_keys, ctx_vals = [], [], [], []
    below_keys, below_vals = None, None
    low = np.uint64((1 << 56) - 1)
    for k in range(ORDER + 1):
        union = np.unique(np.concatenate([p[k][0] for p in per])) if m else np.zeros(0, np.uint64)
        vals = np.zeros((len(union), m), np.float32)
        ctx_of = (union & low) >> np.uint64(8) | np.uint64(k) << np.uint64(56)
        contexts = np.unique(ctx_of)
        where = np.searchsorted(contexts, ctx_of)
        esc = np.zeros((len(contexts), m), np.float32)
        if k:
            suffix = union & np.uint64((1 << (8 * k)) - 1) | np.uint64(k) << np.uint64(56)
            lower = below_vals[np.searchsorted(below_keys, suffix)]
        else:
            lower = np.full((len(union), m), 8.0, np.float32)
        for j in range(m):
            keys, counts = per[j][k]
            n = np.zeros(len(union))
            n[np.searchsorted(union, keys)] = counts
            total, distinct = np.bincount(where, n, len(contexts)), np.bincount(where, n > 0, len(contexts))
            some = total > 0
            e = np.where(some, -np.log2(np.where(some, distinct, 1) / np.where(some, total + distinct, 1)), 0)
            esc[:, j] = e
            with np.errstate(divide="ignore"):
                direct = -np.log2(np.where(n > 0, n, 1) / np.maximum((total + distinct)[where], 1))
            vals[:, j] = np.where(n > 0, direct, e[where] + lower[:, j])
        sym_keys.append(union), sym_vals.append(vals), ctx_keys.append(contexts), ctx_vals.append(esc)
        below_keys, below_vals = union, vals
    if not len(sym_keys[0]):
        return Coder([], Table(np.zeros(0, np.uint64), np.zeros((0, 1))), Table(np.zeros(0, np.uint64), np.zeros((0, 1))))
    return Coder(names, Table(np.concatenate(sym_keys), np.concatenate(sym_vals)), Table(np.concatenate(ctx_keys), np.concatenate(ctx_vals)))


@dataclass
class Folds:
    """Two coders, each for the texts of the other one's fold."""

    coders: list[Coder]
    bits_limit: float = 1e9

    @property
    def languages(self) -> list[str]:
        return self.coders[0].languages

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits under each language, bytes) of each text."""
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, n, buf, off in core.slices(texts, SLICE):
            fold, part = fold_of(buf, off), texts.slice(at, n)
            for k in (0, 1):
                own = np.flatnonzero(fold == k)
                if len(own):
                    bits[at + own], size[at + own] = self.coders[1 - k].score(part.take(pa.array(own)))
        return bits, size

    verdict = Coder.verdict


def fold_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0 or 1 for each text of a slice, by its bytes."""
    return (core.span_hashes(buf, off[:-1], off[1:]) & np.uint64(1)).astype(int)


def folds_of(texts: pa.Array) -> np.ndarray:
    """0 or 1 for each text."""
    out = [fold_of(buf, off) for _, _, buf, off in core.slices(texts, SLICE)]
    return np.concatenate(out) if out else np.zeros(0, int)


def counted(batches, number: dict[str, int]):
    """(fold, language, gram, n): the grams of all orders of rows (lang, text), summed over about 1 MB of text."""
    held, room_left = {}, 1 << 20

    def sent():
        for (fold, l), got in held.items():
            g, n = np.unique(np.concatenate(got), return_counts=True)
            one = np.ones(len(g), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one * np.int32(fold)), pa.array(one * np.int32(l)), pa.array(g.view(np.int64)), pa.array(n)], ["fold", "l", "gram", "n"])
        held.clear()
        core.trim()

    for b in batches:
        names, fold = np.array([number[x] for x in b.column(0).to_pylist()]), folds_of(b.column(1))
        for key in set(zip(fold.tolist(), names.tolist())):
            own = b.column(1).take(pa.array(np.flatnonzero((fold == key[0]) & (names == key[1]))))
            for _, _, buf, off in core.slices(own, SLICE):
                held.setdefault(key, []).extend(levels_of(buf, off))
                room_left -= len(buf)
                if room_left < 0:
                    yield from sent()
                    room_left = 1 << 20
    yield from sent()


def fit(docs: DataFrame, rows: int | None = None) -> Coder | Folds:
    """Trees and limit from all rows with a declared language; or from about ``rows`` rows of each, and the limit from as many others."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("l"), F.col("text").cast("string").alias("t")).where("l IS NOT NULL AND t IS NOT NULL AND t <> ''")
    if rows is not None:
        return fit_some(d, rows)
    tally = {r.l: r.n for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not tally:
        return build({})
    names, total = sorted(tally), sum(tally.values())
    number = {x: k for k, x in enumerate(names)}
    sums, path = core.table(d.select("l", "t").mapInArrow(lambda it: counted(it, number), "fold int, l int, gram bigint, n bigint").groupBy("fold", "l", "gram").agg(F.sum("n").alias("n")))
    coders = []
    for fold in (0, 1):
        own = sums.where(F.col("fold") == fold)
        least, held = 1, own.count()
        if held > GRAMS:  # the least count that leaves few enough
            for r in own.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").limit(1 << 16).collect():
                if held <= GRAMS:
                    break
                least, held = r.n + 1, held - r.k
        got = own.where(F.col("n") >= least).select("l", "gram", "n").toArrow()
        l, g, n = got.column("l").to_numpy(), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.lexsort((g, l))
        l, g, n = l[order], g[order], n[order]
        per = []
        for k in range(len(names)):
            mine = slice(*np.searchsorted(l, [k, k + 1]))
            cut = np.searchsorted(g[mine], [np.uint64(o) << np.uint64(56) for o in range(1, ORDER + 3)])
            per.append([(g[mine][a:z], n[mine][a:z]) for a, z in zip(cut[:-1], cut[1:])])
        coders.append(frozen(names, per))
    core.drop_table(docs.sparkSession, path)
    # All texts in one fold: the other one's trees know nothing.
    coders = [c if c.languages else coders[1 - k] for k, c in enumerate(coders)]
    model = Folds(coders)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def ratio(text: pa.Array) -> pa.Array:
        bits, size = known.value.score(text)
        return pa.array(np.maximum(bits.min(1) - ALLOWANCE, 0) / np.maximum(size, 1))

    # The quantile 0.999 of all rows, interpolated between the two rows about it.
    at = 0.999 * (total - 1)
    top = np.sort([r.x for r in d.select(ratio("t").alias("x")).orderBy(F.desc("x")).limit(total - int(at)).collect()])
    known.destroy()
    model.bits_limit = float(SLACK * (top[0] + (at - int(at)) * (top[min(1, len(top) - 1)] - top[0])))
    return model


def fit_some(d: DataFrame, rows: int) -> Coder:
    """``fit`` on a bounded number of rows (id, l, t)."""
    counts = {r.l: r.n for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build({})
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * rows / n)))])
    u = F.xxhash64("id", "l").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    got = d.where(u < share[F.col("l")]).select("l", "t", u.alias("u")).toPandas().sort_values(["u", "t"])
    fit_on, held = {}, []
    for name, part in got.groupby("l"):
        texts = part["t"].tolist()
        fit_on[name] = texts[0 : 2 * rows : 2] or texts
        held += texts[1 : 2 * rows : 2] or texts
    coder = build(fit_on)
    bits, size = coder.score(pa.array(held, pa.string()))
    coder.bits_limit = float(SLACK * np.quantile(np.maximum(bits.min(1) - ALLOWANCE, 0) / size, 0.999))
    return coder


def score(docs: DataFrame, coder: Coder | Folds, name: str = "__al_lang") -> DataFrame:
    """``docs`` with one more column: struct<lang, bits_per_byte, lead_bits, keep>."""
    known = docs.sparkSession.sparkContext.broadcast(coder)

    @arrow_udf("struct<lang:string,bits_per_byte:double,lead_bits:double,keep:boolean>")
    def verdict(text: pa.Array) -> pa.Array:
        best, bits, lead, keep = known.value.verdict(text)
        names = pa.array(known.value.languages or [None], pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(bits), pa.array(lead), pa.array(keep)], ["lang", "bits_per_byte", "lead_bits", "keep"])

    # Not deterministic for the optimizer only: else the filter on it would run it a second time.
    return docs.withColumn(name, verdict.asNondeterministic()(F.col("text").cast("string")))


def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose language is known, all columns as they came."""
    return score(docs, fit(docs)).where("__al_lang.keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, bits_per_byte, lead_bits) of every document whose language is known."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = score(core.id_text(docs), fit(docs), "s").where("s.keep")
    return s.select("doc_id", F.col("s.lang").alias("language"), F.col("s.bits_per_byte").alias("bits_per_byte"), F.col("s.lead_bits").alias("lead_bits"))
