"""N-gram Jaccard join by chosen paths.

A text's set is its distinct word trigrams (lower-cased ASCII, white-space words; a shorter text has one: all
its words).  Texts of equal sets are collapsed first, exactly.  Every other set is embedded as ``COORDINATES``
(coordinate, minimum hash) tokens, so that a token is shared with probability J.  A run's root
samples ``BRANCH`` = 1 / threshold coordinates, by the run's seed, and a set goes to the bucket of its token at each;
a bucket of more than ``SMALL`` sets is split again on coordinates sampled by its path, and
small ones are compared by brute force, as are those that splitting no longer shrinks.  The number of runs follows from
the target recall at the threshold.  Buckets of more than ``HOT`` sets are split as tables, before any task holds one; what
splitting doesn't shrink below that is dealt to blocks, and every two blocks meet in a task of their own.

Links of n alike texts number n * n / 2, so that no table has a row for each.  Sets are put in homes first: a home's sets resemble its leader,
the least of them that a bucket shows.  Compared means: the share of equal one-byte coordinates isn't ``MARGIN`` below the threshold (which a pair
at the threshold is with a chance of 3e-5); where two sets of different homes are, the two homes meet.  Then all sets of a home, and all
sets of homes that meet, have their exact Jaccard similarities computed from the texts, in blocks of about ``BLOCK`` sets against as many, by matrix products
for the trigrams that many of them have.  A block gives each set's number of links, and few links that connect what all of its links do;
every two homes meet once, so that counts add up.  ``pairs`` lists all links instead.  Links and equal sets give the groups (connected components);
equal texts are never expanded into pairs.

Defined results: null and empty texts and null doc_ids are in no group; rows of one doc_id with different texts are documents of
their own; equal rows count once; ties: a group is named after its least doc_id; an empty table gives no groups; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core
from auditlake.llm.quality import _LOWER

NGRAM, THRESHOLD, RECALL = 3, 0.5, 0.95
COORDINATES, SMALL, DEPTH, HOT = 64, 256, 6, 50_000
#: Sets that lead others in a bucket; sets of a block.
LEADERS, BLOCK = 32, 1000
#: A pair is verified unless its sketch is this far below the threshold (4 standard deviations at J = 0.5).
MARGIN = 0.25
_SEEDS = core.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def branch(threshold: float) -> int:
    return max(1, round(1 / threshold))


def survival(similarity: float, threshold: float, depth: int = DEPTH) -> float:
    """Chance that a pair shares a path of ``depth`` splits, each on ``branch`` sampled coordinates."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** branch(threshold)
    return p


def runs(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold))))


def sampled(path: np.ndarray, threshold: float) -> np.ndarray:
    """Coordinates (len(path), branch) that each path samples."""
    k = np.arange(branch(threshold), dtype=np.uint64)
    return (core.mix(path[:, None] * np.uint64(0x9E3779B97F4A7C15) + k) % np.uint64(COORDINATES)).astype(np.int64)


def shingles(buf: np.ndarray, off: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row, sorted by hash within it, and the rows' first ones."""
    starts, ends, first = core.words(buf, off)
    grams, g_first = core.ngram_hashes(core.span_hashes(_LOWER[buf], starts, ends), first, n)
    row = core.row_of(g_first)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(off)))


def sketches(batches, threshold: float, recall: float):
    n_runs = runs(threshold, recall)
    roots = core.mix(np.arange(1, n_runs + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    at_root = sampled(roots, threshold)
    for b in batches:
        for at, n, buf, off in core.slices(b.column(2)):
            grams, first = shingles(buf, off)
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            f = first[:-1][some]
            low = np.empty((len(some), COORDINATES), np.uint64)
            for k in range(COORDINATES):
                # one odd multiplier each on well-mixed hashes; the top half of the product decides
                low[:, k] = np.minimum.reduceat((grams ^ _SEEDS[k]) * (_SEEDS[(k + 7) % COORDINATES] | np.uint64(1)), f)
            low = core.mix(low)
            h1 = np.add.reduceat(core.mix(grams ^ np.uint64(0x51ED2701)), f)
            h2 = np.bitwise_xor.reduceat(core.mix(grams * np.uint64(0x2545F4914F6CDD1D)), f)
            keys = np.stack([core.mix(roots[r] ^ low[:, i] + np.uint64(i)) for r in range(n_runs) for i in dict.fromkeys(at_root[r])], 1)
            sketch = np.ascontiguousarray((low & np.uint64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, n).take(pa.array(some)), b.column(1).slice(at, n).take(pa.array(some)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), core.list_array(keys.view(np.int64).ravel(), np.arange(len(some) + 1) * keys.shape[1], pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "row_key", "h1", "h2", "keys", "sketch"],
            )


def _alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs, chance hits of one-byte coordinates taken off."""
    out = np.empty(len(a))
    for k in range(0, len(a), 1 << 17):
        out[k : k + (1 << 17)] = (sketch[a[k : k + (1 << 17)]] == sketch[b[k : k + (1 << 17)]]).sum(1)
    return (out / COORDINATES - 1 / 256) / (1 - 1 / 256)


def _all_pairs(size: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs a < b within runs, a bounded number at a time."""
    one = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    more = np.repeat(begin + size, size) - one - 1
    total = np.cumsum(more)
    at = 0
    while at < len(one):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, "right")))
        o, m = one[at:to], more[at:to]
        a = np.repeat(o, m)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        at = to


def _close(sketch: np.ndarray, home: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs of different homes whose sketches are alike; a home's own sets are compared anyway."""
    apart = home[a] != home[b]
    a, b = a[apart], b[apart]
    ok = _alike(sketch, a, b) >= least
    return a[ok], b[ok]


def bucket_pairs(sketch: np.ndarray, home: np.ndarray, path: int, least: float, threshold: float, depth: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (indices) of one bucket of more than SMALL sets."""
    n = len(sketch)
    if depth < DEPTH:
        for k, i in enumerate(dict.fromkeys(sampled(np.array([path], np.uint64), threshold)[0].tolist())):
            order = np.argsort(sketch[:, i], kind="stable")
            cut = np.flatnonzero(np.diff(sketch[order, i])) + 1
            parts = np.split(order, cut)
            if max(map(len, parts)) > 0.9 * n:
                continue  # hardly shrinks: below
            small = [p for p in parts if 1 < len(p) <= SMALL]
            if small:
                flat, size = np.concatenate(small), np.array([len(p) for p in small])
                for a, b in _all_pairs(size, np.cumsum(size) - size):
                    yield _close(sketch, home, flat[a], flat[b], least)
            for p in parts:
                if len(p) > SMALL:
                    nxt = int(core.mix(np.array([path + k * 0x1234567 + int(sketch[p[0], i]) + 1], np.uint64))[0]) >> 1
                    for a, b in bucket_pairs(sketch[p], home[p], nxt, least, threshold, depth + 1):
                        yield p[a], p[b]
        if all(np.bincount(sketch[:, i], minlength=1).max() <= 0.9 * n for i in sampled(np.array([path], np.uint64), threshold)[0]):
            return
    for a, b in _all_pairs(np.array([n]), np.array([0])):
        yield _close(sketch, home, a, b, least)


def whole_buckets(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (key, depth, side, rep, home, sketch) of whole buckets, from rows sorted by key; a bucket may go over any number of batches."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(5)
        sketch = np.frombuffer(col.buffers()[2], np.uint8)[col.offset * COORDINATES : (col.offset + len(col)) * COORDINATES].reshape(-1, COORDINATES)
        rows = (*(b.column(k).to_numpy() for k in range(5)), sketch)
        keys = rows[0]
        if held and held[-1][0][-1] != keys[0]:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        last = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if keys[0] != keys[-1] else 0
        if last:
            held.append(tuple(x[:last] for x in rows))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        held.append(tuple(x[last:].copy() for x in rows))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def leaders(batches, threshold: float):
    """(rep, home): in each bucket the least set leads those like it, then the least of the rest, up to ``LEADERS`` times; one row a set and batch.

    Buckets of more than SMALL sets are cut by two more coordinates, in four ways.  Homes only say which sets are compared in one go.
    """
    for keys, _, _, ids, _, sketch in whole_buckets(batches):
        size = np.diff(np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys)))
        size = np.repeat(size, size)
        few, many = np.flatnonzero((size > 1) & (size <= SMALL)), np.flatnonzero(size > SMALL)
        at, key = [few], [keys[few].view(np.uint64)]
        for t in range(0, COORDINATES if len(many) else 0, COORDINATES // 4):
            at.append(many)
            key.append(core.mix(keys[many].view(np.uint64) ^ core.mix(sketch[many, t + 3].astype(np.uint64) | sketch[many, t + 11].astype(np.uint64) << np.uint64(8) | np.uint64(t << 16))))
        at, key = np.concatenate(at), np.concatenate(key)
        order = np.lexsort((ids[at], key))
        at, key = at[order], key[order]
        rep, home = [], []
        for _ in range(LEADERS):
            if not len(at):
                break
            first = np.ones(len(at), bool)
            first[1:] = key[1:] != key[:-1]
            lead = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            like = _alike(sketch, at, lead) >= threshold
            rep.append(ids[at[like & ~first]]), home.append(ids[lead[like & ~first]])
            rest = ~like & ~first
            at, key = at[rest], key[rest]
        if rep:
            rep, home = np.concatenate(rep), np.concatenate(home)
            order = np.lexsort((home, rep))
            rep, home = rep[order], home[order]
            one = np.ones(len(rep), bool)
            one[1:] = rep[1:] != rep[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(rep[one]), pa.array(home[one])], ["rep", "home"])


def candidates(batches, threshold: float):
    """Pairs of different homes that have a candidate pair of sets, from rows (key, depth, side, rep, home, sketch) sorted by key.

    Side 0 is a whole bucket; of a bucket in blocks, sides 1 and 2 meet, and side 3 is a block that meets itself.
    """
    least = threshold - MARGIN

    def pairs(keys, depth, side, _, home, sketch):
        cut = np.flatnonzero(np.diff(keys)) + 1
        begin = np.concatenate([[0], cut]).astype(np.int64)
        size = np.diff(np.append(begin, len(keys)))
        few = (size > 1) & (size <= SMALL) & (side[begin] == 0)
        for a, b in _all_pairs(size[few], begin[few]):
            a, b = _close(sketch, home, a, b, least)
            yield home[a], home[b]
        for k in np.flatnonzero((size > 1) & ~few):
            own = slice(begin[k], begin[k] + size[k])
            s, h = sketch[own], home[own]
            if side[begin[k]] == 0:
                for a, b in bucket_pairs(s, h, int(keys[begin[k]]) & (2**62 - 1), least, threshold, int(depth[begin[k]])):
                    yield h[a], h[b]
            elif side[begin[k]] == 3:
                for a, b in _all_pairs(np.array([len(h)]), np.array([0])):
                    a, b = _close(s, h, a, b, least)
                    yield h[a], h[b]
            else:
                one, two = np.flatnonzero(side[own] == 1), np.flatnonzero(side[own] == 2)
                step = max(1, 1_000_000 // max(1, len(two)))
                for at in range(0, len(one) if len(two) else 0, step):
                    a, b = _close(s, h, np.repeat(one[at : at + step], len(two)), np.tile(two, len(one[at : at + step])), least)
                    yield h[a], h[b]

    def once(got):
        """Distinct rows, by one sort of their numbers."""
        p = np.concatenate(got)
        homes, at = np.unique(p, return_inverse=True)
        at = at.reshape(-1, 2)
        one = np.unique(at[:, 0] * np.int64(len(homes)) + at[:, 1])
        return np.stack([homes[one // len(homes)], homes[one % len(homes)]], 1)

    def sent(p):
        for k in range(0, len(p), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(p[k : k + (1 << 18), 0]), pa.array(p[k : k + (1 << 18), 1])], ["a", "b"])

    for rows in whole_buckets(batches):
        got, n = [], 0
        for a, b in pairs(*rows):
            if len(a):
                got.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                n += len(a)
            if n > 2_000_000:
                got = [once(got)]
                n = len(got[0])
            if n > 1_000_000:
                yield from sent(got.pop())
                n = 0
        if got:
            yield from sent(once(got))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)): how many elements each two sets share.  Elements of many sets go through matrix products, the others one by one."""
    nx, ny = len(x), len(y)
    out = np.zeros((nx, ny))
    rx, ry = np.repeat(np.arange(nx), [len(s) for s in x]), np.repeat(np.arange(ny), [len(s) for s in y])
    of, cx = np.unique(np.concatenate(x), return_inverse=True)
    gy = np.concatenate(y)
    cy = np.minimum(np.searchsorted(of, gy), len(of) - 1)
    both = of[cy] == gy
    cy, ry = cy[both], ry[both]
    fx, fy = np.bincount(cx, minlength=len(of)), np.bincount(cy, minlength=len(of))
    dense = fx * fy * 128 > nx * ny
    order = np.argsort(cx, kind="stable")  # sets of each element, one element after another
    sets, begin = rx[order], np.cumsum(fx) - fx
    few = np.flatnonzero(~dense[cy])
    total = np.cumsum(fx[cy[few]])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, "right")))
        c = cy[few[at:to]]
        n = fx[c]
        i = sets[np.repeat(begin[c], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        out += np.bincount(i * ny + np.repeat(ry[few[at:to]], n), minlength=nx * ny).reshape(nx, ny)
        at = to
    column = np.cumsum(dense) - 1
    inx, iny = np.flatnonzero(dense[cx] & (fy[cx] > 0)), np.flatnonzero(dense[cy])
    inx, iny = inx[np.argsort(cx[inx], kind="stable")], iny[np.argsort(cy[iny], kind="stable")]
    colx, coly = column[cx[inx]], column[cy[iny]]
    for lo in range(0, int(dense.sum()), 1024):
        a, b = np.zeros((nx, 1024), np.float32), np.zeros((ny, 1024), np.float32)
        own = slice(*np.searchsorted(colx, [lo, lo + 1024]))
        a[rx[inx[own]], colx[own] - lo] = 1
        own = slice(*np.searchsorted(coly, [lo, lo + 1024]))
        b[ry[iny[own]], coly[own] - lo] = 1
        out += a @ b.T
    return out


def similarity(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)): Jaccard similarities of sorted sets."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    if len(x) * len(y) > 16:
        both = overlaps(x, y)
    else:
        both = np.zeros((len(x), len(y)))
        for i, one in enumerate(x):
            for k, two in enumerate(y):
                where = np.searchsorted(two, one)
                both[i, k] = (two[np.minimum(where, len(two) - 1)] == one).sum()
    return both / (nx[:, None] + ny - both)


def forest(ok: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few of the links ``ok`` that connect what all of them connect; ``rows`` and ``columns`` number the sets."""
    label, one, two, left = np.arange(int(max(rows.max(), columns.max())) + 1), [], [], ok
    while True:
        i, k = np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0))
        if not len(i):
            return np.concatenate(one or [rows[:0]]), np.concatenate(two or [rows[:0]])
        a, b = np.concatenate([rows[i], rows[left[:, k].argmax(0)]]), np.concatenate([columns[left[i].argmax(1)], columns[k]])
        one.append(a), two.append(b)
        a, b = np.concatenate(one), np.concatenate(two)
        while True:
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, label[a], low), np.minimum.at(label, label[b], low)
            label = label[label]
        left = ok & (label[rows][:, None] != label[columns])


def exact(batches, threshold: float, listed: bool):
    """Links of each part, from rows sorted by (part, kind, home, block): texts of blocks of homes (kind 0), and which two blocks meet (kind 1).

    Listed they are (a, b, jaccard); else (a, a, number of its links) and (a, b, 0) of links that connect what all of them do.
    """
    texts: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    part, block, others, out = None, None, [], []

    def met():
        """All links of the sets of ``block``, to each other and to those of ``others``."""
        own = texts.get(block)
        if own is None:
            return
        ids, sets = np.array(own[0]), own[1]
        for with_self in (True, False):
            if with_self:
                if block not in others or len(ids) < 2:
                    continue
                theirs, there = ids, sets
            else:
                there = [t for o in others if o != block and o in texts for t in texts[o][1]]
                theirs = np.array([i for o in others if o != block and o in texts for i in texts[o][0]])
                if not there:
                    continue
            j = similarity(sets, there)
            ok = j >= threshold
            if with_self:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            if listed:
                i, k = np.nonzero(np.triu(ok) if with_self else ok)
                out.append((ids[i], theirs[k], j[i, k]))
                continue
            rows = np.arange(len(ids))
            columns = rows if with_self else len(ids) + np.arange(len(theirs))
            a, b = forest(ok, rows, columns)
            every = ids if with_self else np.concatenate([ids, theirs])
            out.append((every[a], every[b], np.zeros(len(a))))
            for who, n in [(ids, ok.sum(1))] + ([] if with_self else [(theirs, ok.sum(0))]):
                out.append((who[n > 0], who[n > 0], n[n > 0].astype(float)))

    def flushed():
        a, b, v = (np.concatenate(x) for x in zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v)], ["a", "b", "v"])

    for batch in batches:
        p, kind, home, number, rep, two, other = (batch.column(k).fill_null(0).to_numpy() for k in range(7))
        # texts of a part are taken together, as most homes are small
        edge = np.flatnonzero((np.diff(p) != 0) | (np.diff(kind) != 0) | (kind[1:] != 0) & ((np.diff(home) != 0) | (np.diff(number) != 0))) + 1
        for lo, hi in zip(np.concatenate([[0], edge]), np.append(edge, len(p))):
            if lo == hi:
                continue
            now = (int(home[lo]), int(number[lo]))
            if block is not None and (p[lo] != part or kind[lo] == 0 or now != block):
                met()
                block, others = None, []
            if p[lo] != part:
                part, texts = p[lo], {}
            if kind[lo] == 0:
                for at, n, buf, off in core.slices(batch.column(7).slice(lo, hi - lo)):
                    grams, first = shingles(buf, off)
                    own = slice(lo + at, lo + at + n)
                    for k, (h, i, r) in enumerate(zip(home[own].tolist(), number[own].tolist(), rep[own].tolist())):
                        ids, sets = texts.setdefault((h, i), ([], []))
                        ids.append(r)
                        sets.append(grams[first[k] : first[k + 1]])
            else:
                block = now
                others += zip(two[lo:hi].tolist(), other[lo:hi].tolist())
            if len(out) > 3000:
                yield flushed()
    if block is not None:
        met()
    if out:
        yield flushed()


def components(edges: DataFrame) -> DataFrame:
    """(id, label): each vertex's least vertex of its component; labels spread over edges and jump to their labels' labels."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, both_path = core.table(both)
    labels, old = core.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("l"))
        step = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("l", "label")).alias("l"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
        new, path = core.table(step.join(jump, step.l == jump.j, "left").select("id", F.least("l", F.coalesce("lj", "l")).alias("label"), (F.least("l", F.coalesce("lj", "l")) < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        core.drop_table(spark, old)
        labels, old = new.select("id", "label"), path
        if not moved:
            core.drop_table(spark, both_path)
            return labels


def among(wanted: DataFrame):
    """Column of (doc_id, row key): false for most rows that aren't among the wanted, never for one that is, by a Bloom filter of bounded size."""
    a, b = wanted.columns
    known = wanted.sparkSession.sparkContext.broadcast(core.bloom(wanted.select(F.xxhash64(a, b).alias("x"))))

    @arrow_udf("boolean")
    def there(x: pa.Array) -> pa.Array:
        return pa.array(core.may_hold(known.value, x.to_numpy(zero_copy_only=False)))

    return lambda doc_id, key: there(F.xxhash64(doc_id, key))


def split(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, depth, side, rep, home, sketch): the buckets of all runs, none of which holds more than ``HOT`` sets."""
    spark, empty = reps.sparkSession, "key bigint, depth int, side int, rep bigint, home bigint, sketch binary"
    level, done = reps.select(F.explode("keys").alias("key"), "rep", "home", "sketch"), None
    for depth in range(1, DEPTH + 1):
        hot, path = core.table(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
        some = hot.limit(1).count()
        small = (level.join(hot, "key", "left_anti") if some else level).select("key", F.lit(depth).alias("depth"), F.lit(0).alias("side"), "rep", "home", "sketch")
        done = small if done is None else done.unionByName(small)
        if not some:
            core.drop_table(spark, path)
            return done
        large = level.join(hot, "key")
        if depth < DEPTH:

            def deeper(batches):
                for b in batches:
                    keys, sketch = b.column(0).to_numpy().view(np.uint64), np.stack([np.frombuffer(x.as_py(), np.uint8) for x in b.column(3)])
                    at = sampled(keys, threshold)
                    for k, i in enumerate(at.T):  # a coordinate that is sampled twice counts once
                        row = np.flatnonzero((at[:, :k] != i[:, None]).all(1))
                        key = core.mix(keys[row] ^ (i[row].astype(np.uint64) << np.uint64(8)) ^ sketch[row, i[row]].astype(np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(c).take(pa.array(row)) for c in (1, 2, 3))], ["key", "rep", "home", "sketch"])

            level, _ = core.table(large.select("key", "rep", "home", "sketch").mapInArrow(deeper, "key bigint, rep bigint, home bigint, sketch binary"))
        else:  # blocks of at most HOT / 2 sets; a set goes to as many tasks as there are blocks

            def dealt(batches):
                for b in batches:
                    keys, reps_ = b.column(0).to_numpy().view(np.uint64), b.column(1)
                    blocks = -(-2 * b.column(4).to_numpy() // HOT) + 1
                    mine = (core.mix(reps_.to_numpy().view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    row = np.repeat(np.arange(len(keys)), blocks)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    me, take = mine[row], pa.array(row)
                    pair = np.minimum(me, other) * (blocks[row] + 1) + np.maximum(me, other)
                    side = np.where(me == other, 3, np.where(me < other, 1, 2)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(core.mix(keys[row] + core.mix(pair.astype(np.uint64))).view(np.int64)), pa.array(np.full(len(row), DEPTH, np.int32)), pa.array(side), *(b.column(c).take(take) for c in (1, 2, 3))], ["key", "depth", "side", "rep", "home", "sketch"])

            done = done.unionByName(large.select("key", "rep", "home", "sketch", "n").mapInArrow(dealt, empty))
    return done


def verified(docs: DataFrame, reps: DataFrame, threshold: float, listed: bool) -> tuple[DataFrame, str]:
    """The table of links that the runs brought together and exact similarity confirms, as ``exact`` gives them."""
    spark, since = docs.sparkSession, core.mark()
    buckets = lambda r: split(r, threshold).repartition("key").sortWithinPartitions("key")
    led = buckets(reps.withColumn("home", F.col("rep"))).mapInArrow(lambda it: leaders(it, threshold), "rep bigint, home bigint").groupBy("rep").agg(F.min("home").alias("home"))
    homed, homed_path = core.table(reps.select("rep", "doc_id", "row_key", "keys", "sketch").join(led, "rep", "left").withColumn("home", F.coalesce("home", "rep")))
    core.release(spark, since, keep=(homed_path,))
    apart, apart_path = core.table(buckets(homed).mapInArrow(lambda it: candidates(it, threshold), "a bigint, b bigint").distinct())
    core.release(spark, since, keep=(homed_path, apart_path))
    size = homed.groupBy("home").agg(F.count("*").alias("n"))
    side = lambda c: size.select(F.col("home").alias(c), F.col("n").alias(f"n_{c}"))
    meet = apart.join(side("a"), "a").join(side("b"), "b")
    # The larger home comes first: it is read in blocks, each with the others in groups of about as many sets.
    swap = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    meet = meet.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(c) for x, y, c in (("a", "b", "one"), ("b", "a", "two"), ("n_a", "n_b", "n_one"), ("n_b", "n_a", "n_two"))])
    meet = meet.unionByName(size.where("n > 1").select(F.col("home").alias("one"), F.col("home").alias("two"), F.col("n").alias("n_one"), F.col("n").alias("n_two")))
    meet, _ = core.table(meet)
    # Small homes about one least neighbour share a part, so that a text is read for few parts.
    near = meet.select("one", "two").union(meet.select("two", "one")).groupBy("one").agg(F.least(F.col("one"), F.min("two")).alias("near"))
    crowd, _ = core.table(meet.groupBy("one").agg(F.sum("n_two").alias("crowd")).join(near, "one"))
    crowd = crowd.join(crowd.where(F.col("crowd") <= BLOCK).groupBy("near").agg(F.sum("crowd").alias("mass")), "near", "left")
    n_parts = max(1, (meet.agg(F.sum("n_two")).first()[0] or 0) // BLOCK)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    until = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    keyed = meet.join(crowd, "one").select("one", "two", "crowd", "near", "mass", "n_two", until("n_one").alias("at"))
    keyed = keyed.select("one", "two", "crowd", "near", "mass", "at", until("n_two").alias("other")).where("one <> two OR at <= other")
    own = F.xxhash64("one", "at", F.pmod(F.xxhash64("two"), blocks("crowd")), "other")
    keyed = keyed.select("one", "at", "two", "other", F.when(F.col("crowd") > BLOCK, own).otherwise(F.pmod(F.when(F.col("mass") <= 4 * BLOCK, F.xxhash64("near")).otherwise(F.xxhash64("one")), F.lit(n_parts))).alias("part"))
    keyed, _ = core.table(keyed)
    who = keyed.select("part", F.col("one").alias("home"), F.col("at").alias("block")).union(keyed.select("part", "two", "other")).distinct()
    members = homed.join(size, "home").select("home", F.pmod(F.xxhash64("rep"), blocks("n")).cast("int").alias("block"), "rep", "doc_id", "row_key")
    wanted, _ = core.table(who.join(members, ["home", "block"]))
    text = docs.where(among(wanted.select("doc_id", "row_key").distinct())("doc_id", "row_key")).groupBy("doc_id", "row_key").agg(F.min("text").alias("text"))
    text = text.join(wanted.hint("merge"), ["doc_id", "row_key"])
    none = F.lit(None)
    rows = text.select("part", F.lit(0).alias("kind"), "home", "block", "rep", none.cast("long").alias("two"), none.cast("int").alias("other"), "text")
    rows = rows.unionByName(keyed.select("part", F.lit(1).alias("kind"), F.col("one").alias("home"), F.col("at").alias("block"), none.cast("long").alias("rep"), "two", "other", none.cast("string").alias("text")))
    rows = rows.repartition("part").sortWithinPartitions("part", "kind", "home", "block")
    near, path = core.table(rows.mapInArrow(lambda it: exact(it, threshold, listed), "a bigint, b bigint, v double"))
    core.release(spark, since, keep=(path,))
    return near, path


def classes(docs: DataFrame, threshold: float, recall: float, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of documents, classes of equal sets, links of classes), all written.

    sets (doc_id, row_key, h1, h2); classes (rep, doc_id, row_key, n, h1, h2), where rep numbers a class and doc_id is its least; links (a, b, v) of reps as ``exact`` gives them.
    """
    spark, since = docs.sparkSession, core.mark()
    base = core.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", core.row_key().alias("row_key"), "text")
    sets, sets_path = core.table(base.mapInArrow(lambda it: sketches(it, threshold, recall), "doc_id bigint, row_key bigint, h1 bigint, h2 bigint, keys array<bigint>, sketch binary"))
    least = sets.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row_key", "keys", "sketch")).alias("m"), F.count("*").alias("n"))
    reps, reps_path = core.table(least.select(F.monotonically_increasing_id().alias("rep"), "m.*", "n", "h1", "h2"))
    near, near_path = verified(base, reps, threshold, listed)
    core.release(spark, since, keep=(sets_path, reps_path, near_path))
    return sets.select("doc_id", "row_key", "h1", "h2"), reps.drop("keys", "sketch"), near


def pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all pairs of classes of equal sets that are similar; a class goes by its least doc_id."""
    _, reps, near = classes(docs, threshold, recall, True)
    name = lambda c: reps.select(F.col("rep").alias(c), F.col("doc_id").alias(f"doc_id_{c}"))
    return near.join(name("a"), "a").join(name("b"), "b").select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"), F.col("v").alias("jaccard"))


def keyed_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, row_key, group_id, group_key, links, copies) of every document that has a near copy; written.

    The group goes by its least (doc_id, row_key).  links counts the other texts that are similar to this one, copies the documents of an equal set besides it.
    """
    spark, since = docs.sparkSession, core.mark()
    sets, reps, near = classes(docs, threshold, recall, False)
    linked = near.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("v").cast("long").alias("links"))
    label = components(near.where("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    named = reps.join(label, "rep", "left").join(linked, "rep", "left").where("n > 1 OR label IS NOT NULL")
    named, named_path = core.table(named.select("h1", "h2", "doc_id", "row_key", "n", F.coalesce("label", "rep").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    heads = named.groupBy("label").agg(F.min(F.struct("doc_id", "row_key")).alias("head"))
    # Equal rows (doc_id, row_key) count once.
    members = sets.join(named.join(heads, "label").select("h1", "h2", "n", "links", F.col("head.doc_id").alias("group_id"), F.col("head.row_key").alias("group_key")), ["h1", "h2"])
    members = members.groupBy("doc_id", "row_key").agg(*[F.min(c).alias(c) for c in ("group_id", "group_key", "links", "n")], F.count("*").alias("often"))
    out, path = core.table(members.select("doc_id", "row_key", "group_id", "group_key", "links", (F.col("n") - F.col("often")).alias("copies")).where("copies > 0 OR links > 0"))
    core.release(spark, since, keep=(path,))
    return out


def groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the group's least doc_id."""
    return keyed_groups(docs, threshold, recall).select("doc_id", "group_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group only the row of least (doc_id, row_key) stays, and one of equal rows."""
    gone = keyed_groups(docs).where("doc_id <> group_id OR row_key <> group_key").select(F.col("doc_id").alias("__al_gone"), F.col("row_key").alias("__al_key"))
    on = (F.col("doc_id").cast("long") == F.col("__al_gone")) & (core.row_key() == F.col("__al_key"))
    docs = core.one_of_equal_rows(docs)  # equal rows stay or go together
    perhaps = among(gone)(F.col("doc_id").cast("long"), core.row_key())
    # Texts that stay aren't shuffled, however many go.
    return docs.where(~perhaps).unionByName(docs.where(perhaps).join(gone, on, "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, links, copies) of every document that has a near copy: its group's least doc_id, how many other texts it is
    linked to, and how many documents equal it."""
    return keyed_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("group_id").alias("class_id"), "links", "copies")
