"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all trees.

Every level of a tree projects on one seeded Gaussian direction; a node splits at the median of the
projections that reach it.  A query starts at all roots; the queue always opens the node whose least
margin on its path is best, over all trees, until enough leaves are open.  A leaf's vectors are
candidates, reranked by exact Euclidean distance.  Queries are the rows whose id is divisible by ``every``, against all rows.

How many leaves are enough is measured, so that recall holds at any size and shape of data: ``PROBES`` rows
are compared with the whole table, and the number is the least at which the queue reaches ``RECALL`` of
their true neighbours.

Trees hold one direction a level and one number a node.  Medians come from a bounded sample of about ``SAMPLE`` rows; every row is
indexed.  Leaves hold about ``LEAF`` rows up to ``SAMPLE / 2 * LEAF`` rows (25 million), and more beyond that.
A vector goes to its leaf of each tree, and a query's vector to the leaves it opens, in one shuffle.  A leaf with more than ``CELL``
rows, or one that more than ``CELL`` queries open (many equal vectors, say), is cut into blocks of rows times blocks of queries, each a group of its own.

Defined results: rows with a null id, a null vector, a null or non-finite component, or a vector that isn't of the most common
length (ties: the shorter) are neither queries nor neighbours; repeated rows (same id) count once, by their least vector; ties in
distance rank by id, however many there are; a row is no neighbour of itself; fewer than k others give fewer rows; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import core

K, TREES, LEAF, SEED, SAMPLE, CELL = 10, 8, 512, 11, 100_000, 16_384
RECALL, PROBES, EVERY = 0.95, 192, 20
SCHEMA = "vec_id bigint, neighbour_id bigint, distance double, rank int"


@dataclass
class Forest:
    directions: np.ndarray  # (trees, depth, dim)
    splits: np.ndarray  # (trees, 2 ** depth - 1), nodes in breadth-first order
    depth: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, depth)"""
        t, d, n = self.directions.shape
        return (x @ self.directions.reshape(t * d, n).T).reshape(len(x), t, d)

    def own_leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector."""
        node = np.zeros((len(x), len(self.splits)), np.int64)
        if self.depth:
            p = self.project(x)
            tree = np.arange(len(self.splits))
            for d in range(self.depth):
                node = 2 * node + 1 + (p[:, :, d] > self.splits[tree, node])
        return node - (2**self.depth - 1)

    def search(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """(rows, leaves): tree * 2**depth + leaf of the leaves the queue opens first; -1 if there are fewer."""
        n, trees = len(x), len(self.splits)
        out = np.full((n, leaves), -1, np.int64)
        if not self.depth:
            out[:, : min(trees, leaves)] = np.arange(min(trees, leaves))
            return out
        p, inner = self.project(x), 2**self.depth - 1
        # opening a leaf's path takes depth pops; every pop opens one node and queues its other side
        prio = np.full((n, trees + 1), -np.inf)
        tree_of, node_of = np.zeros((n, trees + 1), np.int64), np.zeros((n, trees + 1), np.int64)
        prio[:, :trees], tree_of[:, :trees] = np.inf, np.arange(trees)
        used, found, row = trees, np.zeros(n, np.int64), np.arange(n)
        level = np.concatenate([np.full(2**d, d) for d in range(self.depth)])
        active = row
        while len(active):
            if used >= prio.shape[1]:
                grow = lambda a, v: np.concatenate([a, np.full((n, 64), v, a.dtype)], 1)
                prio, tree_of, node_of = grow(prio, -np.inf), grow(tree_of, 0), grow(node_of, 0)
            at = prio[active, :used].argmax(1)
            best, t, v = prio[active, at], tree_of[active, at], node_of[active, at]
            empty = best == -np.inf
            leaf = (v >= inner) & ~empty
            done = active[leaf]
            out[done, found[done]] = t[leaf] * 2**self.depth + v[leaf] - inner
            found[done] += 1
            prio[done, at[leaf]] = -np.inf
            split = ~leaf & ~empty
            a, t, v, at, best = active[split], t[split], v[split], at[split], best[split]
            margin = p[a, t, level[v]] - self.splits[t, v]
            right = margin > 0
            node_of[a, at], prio[a, at] = 2 * v + 1 + right, np.minimum(best, np.abs(margin))
            node_of[a, used], tree_of[a, used], prio[a, used] = 2 * v + 2 - right, t, np.minimum(best, -np.abs(margin))
            used += 1
            active = active[~empty & (found[active] < leaves)]
        return out


def grow(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Trees for a table of ``rows`` vectors, medians from ``sample``; at least 2 sampled vectors stay in a leaf."""
    depth = 0
    while rows / 2**depth > leaf and len(sample) / 2 ** (depth + 1) >= 2:
        depth += 1
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.ndim == 2 else 0
    f = Forest(rng.standard_normal((trees, depth, dim)) / np.sqrt(max(dim, 1)), np.zeros((trees, 2**depth - 1)), depth)
    if depth:
        p = f.project(sample)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for d in range(depth):
                order = np.lexsort((p[:, t, d], node))
                first = np.searchsorted(node[order], np.arange(2**d - 1, 2 ** (d + 1) - 1))
                last = np.append(first[1:], len(node))
                mid = np.minimum((first + last) // 2, len(node) - 1)
                lo = np.maximum(mid - 1, 0)
                f.splits[t, 2**d - 1 : 2 ** (d + 1) - 1] = (p[order[mid], t, d] + p[order[lo], t, d]) / 2
                node = 2 * node + 1 + (p[:, t, d] > f.splits[t, node])
    return f


def vectors_of(df: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part."""
    kind = "array<float>" if dict(df.dtypes)[column] == "array<float>" else "array<double>"
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    d = d.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size("v") == (common[0]["n"] if common else 1)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _nearest(x: np.ndarray, x_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, distance) of the k rows of y that are nearest to each row of x, not itself."""
    out, norm = [], (y * y).sum(1)
    for q in range(0, len(x), 512):
        z, me = x[q : q + 512], x_id[q : q + 512]
        d = norm - 2 * (z @ y.T) + (z * z).sum(1)[:, None]
        d[me[:, None] == y_id] = np.inf
        m = min(k, len(y))
        limit = np.partition(d, m - 1, 1)[:, m - 1]  # and all that are as near, but for rounding: exact distances and ids decide
        r, c = np.nonzero((d <= (limit + 1e-9 * (1 + norm.max() + (z * z).sum(1)))[:, None]) & (d < np.inf))
        out.append((me[r], y_id[c], np.sqrt(((z[r] - y[c]) ** 2).sum(1))))
    q, n, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return _top(q, n, d, k)


def enough_leaves(base: DataFrame, forest: Forest, rows: int, k: int, recall: float, probes: int) -> int:
    """Leaves that the queue must open to reach ``recall`` of the true neighbours of the probes (rows of least hash)."""
    if not forest.depth or rows < 2:
        return len(forest.splits)
    got = base.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(probes).toArrow()
    x, x_id = _matrix(got.column("v").combine_chunks()), got.column("id").to_numpy()

    def brute(batches):
        for b in batches:
            q, n, d = _nearest(x, x_id, _matrix(b.column(1)), b.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d)], ["vec_id", "neighbour_id", "distance"])

    true = best_of(base.select("id", "v").mapInArrow(brute, "vec_id bigint, neighbour_id bigint, distance double"), k)
    near = base.join(F.broadcast(true.select("vec_id", F.col("neighbour_id").alias("id"))), "id").select("vec_id", "v").toArrow()
    row_of = {int(i): r for r, i in enumerate(x_id)}
    row = np.array([row_of[int(i)] for i in near.column("vec_id").to_numpy()], np.int64)
    width = 2**forest.depth
    own = forest.own_leaves(_matrix(near.column("v").combine_chunks())) + np.arange(len(forest.splits)) * width
    most = len(forest.splits) * width
    leaves = 64
    while True:
        leaves = min(leaves, most)
        order = forest.search(x, leaves)
        r, c = np.nonzero(order >= 0)
        code = r * most + order[r, c]
        by = np.argsort(code)
        code, c = code[by], c[by]
        ask = row[:, None] * most + own
        at = np.minimum(np.searchsorted(code, ask), len(code) - 1)
        first = np.sort(np.where(code[at] == ask, c[at], leaves).min(1))
        need = int(first[min(len(first) - 1, int(np.ceil(recall * len(first))))]) + 1 if len(first) else 1
        if need <= leaves or leaves == most:
            return min(need, most)
        leaves *= 2


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each vec_id, ranked."""

    def last(batches):
        held = None
        for b in batches:
            q, n, d = (b.column(c).to_numpy() for c in range(3))
            if held is not None:
                q, n, d = np.append(held[0], q), np.append(held[1], n), np.append(held[2], d)
            cut = int(np.searchsorted(q, q[-1])) if len(q) else 0
            held = (q[cut:], n[cut:], d[cut:])
            if cut:
                yield _ranked(*_top(q[:cut], n[:cut], d[:cut], k))
        if held is not None and len(held[0]):
            yield _ranked(*_top(*held, k))

    return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(last, SCHEMA)


def neighbours(df: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE, every: int = 1, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): the k nearest others of every row whose id is divisible by ``every``."""
    base, _ = core.table(vectors_of(df, id_col, column))
    rows = base.count()
    u = F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    got = base.where(u < min(1.0, 1.1 * sample / max(rows, 1))).toArrow().sort_by("id")
    forest = grow(_matrix(got.column("v").combine_chunks()) if len(got) else np.zeros((0, 1)), rows, trees, leaf)
    leaves = enough_leaves(base, forest, rows, k, recall, PROBES)
    width, kind_of = 2**forest.depth, dict(base.dtypes)["v"]
    n_cells, tree_at = len(forest.splits) * width, np.arange(len(forest.splits)) * width

    def cells_of(cells_for, name: str):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    cells = cells_for(_matrix(part.column("v")))
                    first = np.concatenate([[0], np.cumsum((cells >= 0).sum(1))])
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), core.list_array(cells[cells >= 0], first, pa.int64())], ["id", "v", name])

        return run

    kind = f"id bigint, v {kind_of}, cells array<bigint>"
    own = base.mapInArrow(cells_of(lambda x: forest.own_leaves(x) + tree_at, "cells"), kind)
    asks, _ = core.table(base.where(F.col("id") % every == 0).mapInArrow(cells_of(lambda x: forest.search(x, leaves), "cells"), kind))

    def sizes(d: DataFrame) -> np.ndarray:
        """Rows of each cell: counted in each task before they meet."""

        def tally(batches):
            n = np.zeros(n_cells, np.int64)
            for b in batches:
                n += np.bincount(np.asarray(b.column(0).flatten()), minlength=n_cells)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

        got = d.select("cells").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(n_cells, np.int64)
        out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        return out

    blocks, copies = np.maximum(1, -(-sizes(own) // CELL)), np.maximum(1, -(-sizes(asks) // CELL))
    begin = np.concatenate([[0], np.cumsum(blocks * copies)])

    def spread(side: int):
        """Row: one of its cell's blocks, in all copies; query: one of the copies, in all blocks."""

        def run(batches):
            for b in batches:
                flat, counts = np.asarray(b.column(2).flatten()), np.asarray(pa.compute.list_value_length(b.column(2)))
                row = np.repeat(np.arange(b.num_rows), counts)
                h = core.mix(b.column(0).to_numpy().view(np.uint64))[row] >> np.uint64(1)
                mine, all_ = (blocks, copies) if side == 0 else (copies, blocks)
                times = all_[flat]
                fixed = np.repeat((h % mine[flat].astype(np.uint64)).astype(np.int64), times)
                other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                c, row = np.repeat(flat, times), np.repeat(row, times)
                group = begin[c] + (fixed * copies[c] + other if side == 0 else other * copies[c] + fixed)
                for at in range(0, len(group), 1 << 16):
                    take = pa.array(row[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(group[at : at + (1 << 16)]), pa.array(np.full(len(take), side, np.int32)), b.column(0).take(take), b.column(1).take(take)], ["cell", "kind", "id", "v"])

        return run

    out = f"cell bigint, kind int, id bigint, v {kind_of}"
    cells = own.mapInArrow(spread(0), out).unionByName(asks.mapInArrow(spread(1), out))

    def rerank(batches):
        """Of rows sorted by (cell, kind), vectors before queries: each query's k best in the cell."""
        cell, ids, vecs = None, [], []
        for b in batches:
            c, kind, i = (b.column(n).to_numpy() for n in range(3))
            x = _matrix(b.column(3))
            edge = np.flatnonzero((np.diff(c, prepend=c[0] if len(c) else 0) != 0) | (np.diff(kind, prepend=kind[0] if len(kind) else 0) != 0))
            best = []
            for lo, hi in zip(np.concatenate([[0], edge]), np.append(edge, len(c))):
                if lo == hi:
                    continue
                if c[lo] != cell:
                    cell, ids, vecs = c[lo], [], []
                if kind[lo] == 0:
                    ids.append(i[lo:hi].copy()), vecs.append(x[lo:hi].copy())
                elif ids:
                    own, y = np.concatenate(ids), np.concatenate(vecs)
                    ids, vecs = [own], [y]
                    best.append(_nearest(x[lo:hi], i[lo:hi], y, own, k))
            if best:
                q, n, d = (np.concatenate(z) for z in zip(*best))
                q, n, d = _top(q, n, d, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d)], ["vec_id", "neighbour_id", "distance"])

    found = cells.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(rerank, "vec_id bigint, neighbour_id bigint, distance double")
    return best_of(found, k)


def _top(q: np.ndarray, n: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct neighbours of each query, nearest first."""
    order = np.lexsort((n, d, q))
    q, n, d = q[order], n[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])  # a pair has the same distance wherever it was found
    q, n, d = q[new], n[new], d[new]
    begin = np.searchsorted(q, q)
    keep = np.arange(len(q)) - begin < k
    return q[keep], n[keep], d[keep]


def _ranked(q, n, d) -> pa.RecordBatch:
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d), pa.array(rank.astype(np.int32))], ["vec_id", "neighbour_id", "distance", "rank"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by ``EVERY``, among all vectors."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
