"""Quality rules: gradient-boosted trees over document statistics.

``stat_matrix`` computes 19 statistics of each text from its raw bytes (numpy, one Arrow
batch at a time); two boosted ensembles, one for ``labels.quality`` and one for
``labels.toxic``, are fitted by histogram boosting with monotonic constraints and flattened
into numpy node arrays that score a whole batch at once.  A document is kept when
``quality_score >= min_quality`` and ``toxic_score < max_toxic``.

Defined results: null and empty texts are rejected (both scores are 0); repeated rows and ties get the same
scores each; an empty table gives an empty result; without both classes among the labelled rows
the ensemble is the constant rate of its label, or keeps everything if there are no labels at all;
rows whose doc_id is null are scored like any other; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core

#: At most so many labelled rows, those of least hash of doc_id, fit the ensembles (a documented bound).
LABELLED_ROWS = 12_000
MIN_QUALITY, MAX_TOXIC = 0.4, 0.5
#: A lexicon entry is a word or a beginning of so many bytes of a longer one; toxic rows are at least PURITY of its rows, by a
#: one-sided 95 % Wilson bound: 3 of 3 rows pass, 2 of 2 do not.
BEGINNINGS, PURITY, CONFIDENCE_Z = (3, 4, 5, 6, 8), 0.5, 1.645

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "punct_share", "space_share", "high_byte_share",
    "line_count_log", "mean_line_log", "repeat_line_share", "distinct_word_share", "top_word_share", "symbol_word_share", "upper_word_share", "repeat_bigram_share", "lexicon_share", "log_lexicon_words",
]
#: +1: the score may only grow with the statistic, -1: only fall.
QUALITY_MONOTONE = {"symbol_share": -1, "symbol_word_share": -1, "upper_word_share": -1, "repeat_line_share": -1, "repeat_bigram_share": -1}
TOXIC_MONOTONE = {"lexicon_share": 1, "log_lexicon_words": 1}

_CLASS = np.zeros((6, 256), np.uint8)
_CLASS[0, 65:91] = 1  # upper
_CLASS[1, 48:58] = 1  # digit
for _c in b"#$%&*+<=>@\\^_`{|}~[]":
    _CLASS[2, _c] = 1  # symbol
for _c in b"!\"'(),-./:;?":
    _CLASS[3, _c] = 1  # punctuation
_CLASS[4, [9, 10, 11, 12, 13, 32]] = 1
_CLASS[5, 128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _share_repeated(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: distinct keys, items, count of its most frequent key."""
    items = np.bincount(rows, minlength=n)
    if not len(keys):
        return np.zeros(n), items, np.zeros(n)
    tag = keys & ~np.uint64(0xFFFFF) | rows.astype(np.uint64) & np.uint64(0xFFFFF)
    tag = np.sort((tag << np.uint64(44)) | (tag >> np.uint64(20)))  # by row, then key
    new = np.ones(len(tag), bool)
    new[1:] = tag[1:] != tag[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(tag)))
    of = (tag[at] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, run)
    return np.bincount(of, minlength=n), items, top


def stat_matrix(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at, n, buf, off in core.slices(texts):
        size = np.maximum(np.diff(off), 1).astype(float)
        x = out[at : at + n]
        low = _LOWER[buf]
        starts, ends, first = core.words(buf, off)
        rows = core.row_of(first)
        n_words = np.diff(first).astype(float)
        some = np.maximum(n_words, 1)
        x[:, 0], x[:, 1] = np.log1p(np.diff(off)), np.log1p(n_words)
        x[:, 2] = core.per_row((ends - starts).astype(np.int64), first) / some
        counts = [core.per_row(_CLASS[k][buf].astype(np.int32), off) for k in range(6)]
        for k, f in enumerate((3, 4, 5, 6, 7, 8)):
            x[:, f] = counts[k] / size
        new_line = np.flatnonzero(buf == 10)
        lines = np.searchsorted(new_line, off)
        n_lines = np.diff(lines) + 1.0
        x[:, 9], x[:, 10] = np.log1p(n_lines), np.log1p(size / n_lines)
        l_start = np.sort(np.concatenate([off[:-1][np.diff(off) > 0], new_line + 1]))
        l_row = np.searchsorted(off, l_start, "right") - 1
        l_start, l_row = l_start[l_row < n], l_row[l_row < n]
        l_end = np.minimum(np.append(l_start[1:], len(buf)), off[l_row + 1])
        l_end = l_end - ((l_end > l_start) & (buf[np.maximum(l_end - 1, 0)] == 10))
        full = l_end > l_start
        distinct, items, _ = _share_repeated(core.span_hashes(buf, l_start[full], l_end[full]), l_row[full], n)
        x[:, 11] = 1 - distinct / np.maximum(items, 1)
        h = core.span_hashes(low, starts, ends)
        distinct, items, top = _share_repeated(h, rows, n)
        x[:, 12], x[:, 13] = distinct / some, top / some
        last = np.maximum(ends - 1, 0)
        x[:, 14] = np.bincount(rows, _CLASS[2][buf[last]] if len(rows) else None, minlength=n) / some if len(rows) else 0
        second = np.minimum(starts + 1, last) if len(rows) else last
        x[:, 15] = np.bincount(rows, (_CLASS[0][buf[starts]] & _CLASS[0][buf[second]]), minlength=n) / some if len(rows) else 0
        pairs, p_first = core.ngram_hashes(h, first, 2)
        distinct, items, _ = _share_repeated(pairs, core.row_of(p_first), n)
        x[:, 16] = 1 - distinct / np.maximum(items, 1)
        if len(lexicon) and len(rows):
            known = np.zeros(len(rows), bool)
            for at, h in _lexical(low, starts, ends):
                known[at] |= lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
            hits = np.bincount(rows, known, minlength=n)
            x[:, 17], x[:, 18] = hits / some, np.log1p(hits)
    return out


def _lexical(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(numbers of words, their hashes): of whole words without a trailing mark, then of each length in BEGINNINGS of the words that are longer."""
    ends = _bare_ends(low, starts, ends)
    yield np.arange(len(starts)), core.span_hashes(low, starts, ends)
    for size in BEGINNINGS:
        at = np.flatnonzero(ends - starts > size)
        yield at, core.span_hashes(low, starts[at], starts[at] + size) ^ np.uint64(0x4F1BBCDCBFA53E0B + size)


def _bare_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word ends without one trailing punctuation byte."""
    cut = (_CLASS[3][buf[ends - 1]] > 0) & (ends - starts > 1)
    return ends - cut


# --- boosting ----------------------------------------------------------------


@dataclass
class Trees:
    """Flat node arrays of all trees; node i of a leaf points at itself."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows descend all trees together."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x) if len(self.roots) else 0, 8192):
            part = x[a : a + 8192]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                go = part[row, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out[a : a + 8192] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0) -> Trees:
    """Second-order histogram boosting of logistic loss.

    A leaf holds at least an eighth of the rarer class's rows, 4 to 20.

    A split on a constrained feature is refused when its leaf values break the order, and the
    middle of the two values then bounds the values in either subtree, so whole trees are monotone.
    """
    rate_of = float(np.mean(y)) if len(y) else 1.0
    p = min(max(rate_of, 1e-3), 1 - 1e-3)
    trees = Trees(float(np.log(p / (1 - p))), depth=depth)
    least = int(np.clip(min(y.sum(), len(y) - y.sum()) // 8, 4, 20))
    if len(y) < 2 * least or rate_of in (0.0, 1.0):
        return trees
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], 1)  # code <= k  <=>  x <= cuts[k]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    raw = np.full(n, trees.base)

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, lo, hi, d = todo.pop()
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if d < depth and len(rows) >= 2 * least:
                for f in range(m):
                    size = len(cuts[f]) + 1
                    c = code[rows, f]
                    gl, hl, nl = np.cumsum(np.bincount(c, g[rows], size))[:-1], np.cumsum(np.bincount(c, h[rows], size))[:-1], np.cumsum(np.bincount(c, minlength=size))[:-1]
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    if not ok.any():
                        continue
                    wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(G - gl) / (H - hl + l2), lo, hi)
                    sign = monotone.get(f, 0)
                    ok &= sign * (wr - wl) >= 0
                    w = np.clip(-G / (H + l2), lo, hi)
                    loss = lambda G, H, w: G * w + 0.5 * (H + l2) * w * w
                    gain = np.where(ok, loss(G, H, w) - loss(gl, hl, wl) - loss(G - gl, H - hl, wr), -np.inf)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (f, at, wl[at], wr[at], sign))
            if best[1] is None:
                value[k] = rate * float(np.clip(-G / (H + l2), lo, hi))
                raw[rows] += value[k]
                continue
            f, at, wl, wr, sign = best[1]
            feature[k], threshold[k], left[k], right[k] = f, float(cuts[f][at]), node(), node()
            middle = (wl + wr) / 2
            bounds = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle)), 0: ((lo, hi), (lo, hi))}[sign]
            goes = code[rows, f] <= at
            todo += [(left[k], rows[goes], *bounds[0], d + 1), (right[k], rows[~goes], *bounds[1], d + 1)]
    trees.feature, trees.threshold = np.array(feature, np.int32), np.array(threshold)
    trees.left, trees.right, trees.value, trees.roots = np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32)
    return trees


# --- fitting and scoring -------------------------------------------------------


@dataclass
class Model:
    quality: Trees
    toxic: Trees
    lexicon: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = stat_matrix(texts, self.lexicon)
        q, t = self.quality.score(x), self.toxic.score(x)
        blank = x[:, 1] == 0
        q[blank], t[blank] = 0, 0
        return q, t


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Text and both labels of the ``bound`` labelled ids of least hash (one row an id)."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    ids = ids.where("doc_id IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL").groupBy("doc_id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return core.id_text(docs).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "q", "t")


def _lexicon(rows: DataFrame) -> np.ndarray:
    """Hashes of all words and word beginnings that, by PURITY's bound, hardly any document but toxic ones has."""

    def frequencies(batches):
        for b in batches:
            ids, flags = [], []
            tox = np.asarray(b.column(1).to_numpy(zero_copy_only=False))
            for at, n, buf, off in core.slices(b.column(0)):
                starts, ends, first = core.words(buf, off)
                if not len(starts):
                    continue
                of = core.row_of(first)
                found = [(of[w], h) for w, h in _lexical(_LOWER[buf], starts, ends)]
                row, h = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                ids.append(h[new]), flags.append(tox[at + row[new]])
            if ids and sum(map(len, ids)):
                key, inv = np.unique(np.concatenate(ids), return_inverse=True)
                f = np.concatenate(flags)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(inv, minlength=len(key)), pa.int64()), pa.array(np.bincount(inv, f, minlength=len(key)).astype(np.int64))], ["h", "n", "t"])

    # The bound leaves out words of few documents, so they go before the shuffle's result reaches the driver.
    counts = rows.select("text", "t").mapInArrow(frequencies, "h bigint, n bigint, t bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share, zz = F.col("t") / F.col("n"), CONFIDENCE_Z**2
    lowest = (share + zz / (2 * F.col("n")) - CONFIDENCE_Z * F.sqrt(share * (1 - share) / F.col("n") + zz / (4 * F.col("n") * F.col("n")))) / (1 + zz / F.col("n"))
    pure = counts.where(lowest >= PURITY).select("h")
    return np.sort(np.array([r.h for r in pure.collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> Model:
    """Fit both ensembles on at most ``bound`` labelled rows; only their statistics reach the driver."""
    rows = _labelled(docs, labels, bound)
    lexicon = _lexicon(rows)

    def stats(batches):
        for b in batches:
            x = stat_matrix(b.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), b.column(1), b.column(2), b.column(3)], ["x", "q", "t", "doc_id"])

    got = rows.select("text", "q", "t", "doc_id").mapInArrow(stats, "x array<double>, q int, t int, doc_id bigint").toArrow()
    if len(got) == 0:
        keep = Trees(8.0)
        return Model(keep, Trees(-8.0), lexicon)
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(len(got), -1)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    q, t = got.column("q").to_numpy().astype(float), got.column("t").to_numpy().astype(float)
    sign = lambda names: {FEATURES.index(k): v for k, v in names.items()}
    return Model(fit_trees(x[order], q[order], sign(QUALITY_MONOTONE)), fit_trees(x[order], t[order], sign(TOXIC_MONOTONE)), lexicon)


def score(docs: DataFrame, model: Model, name: str = "__al_quality") -> DataFrame:
    """``docs`` with one more column: struct<quality double, toxic double>."""

    @arrow_udf("struct<quality:double,toxic:double>")
    def scores(text: pa.Array) -> pa.Array:
        q, t = model.scores(text)
        return pa.StructArray.from_arrays([pa.array(q), pa.array(t)], ["quality", "toxic"])

    # Not deterministic for the optimizer only: else the filter on it would run it a second time.
    return docs.withColumn(name, scores.asNondeterministic()(F.col("text").cast("string")))


def _keeps(name: str):
    return (F.col(f"{name}.quality") >= MIN_QUALITY) & (F.col(f"{name}.toxic") < MAX_TOXIC)


def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that the rules keep, all columns as they came."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(_keeps("__al_quality")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality_score, toxic_score) of every document that the rules keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = score(core.id_text(docs), model, "s").where(_keeps("s"))
    return s.select("doc_id", F.col("s.quality").alias("quality_score"), F.col("s.toxic").alias("toxic_score"))
