"""Nearest neighbours against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import forest


def brute(ids, x, k):
    d = ((x[:, None, :] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    return {int(i): {int(ids[j]) for j in row} for i, row in zip(ids, near)}, np.sqrt(np.sort(d, 1)[:, :k])


def test_recall_with_many_leaves(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = forest.neighbours(df, leaf=32).collect()
    want, dist = brute(ids, x, forest.K)
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, {})[r.neighbour_id] = (r.rank, r.distance)
    assert set(mine) == set(want) and all(len(v) == forest.K for v in mine.values())
    assert np.mean([len(want[i] & set(mine[i])) / forest.K for i in want]) >= 0.9
    for i, v in list(mine.items())[:50]:
        ranks = sorted(v.values())
        assert [r for r, _ in ranks] == list(range(1, forest.K + 1)) and [d for _, d in ranks] == sorted(d for _, d in ranks)
        assert i not in v


def test_queue_opens_the_best_margins_first():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6))
    f = forest.grow(x, 400, trees=3, leaf=20)
    assert f.depth >= 4
    got = f.search(x[:5], 7)
    p = f.project(x[:5])
    for q in range(5):
        least = {}
        for t in range(3):
            for leaf in range(2**f.depth):
                node, worst = leaf + 2**f.depth - 1, np.inf
                while node:
                    up, right = (node - 1) // 2, node % 2 == 0
                    d = int(np.log2(up + 1))
                    m = p[q, t, d] - f.splits[t, up]
                    worst = min(worst, abs(m) if (m > 0) == right else -abs(m))
                    node = up
                least[t * 2**f.depth + leaf] = worst
        best = sorted(least.values(), reverse=True)[:7]
        assert np.allclose(sorted((least[c] for c in got[q]), reverse=True), best)
    own = f.own_leaves(x[:5]) + np.arange(3) * 2**f.depth
    whole = f.search(x[:5], 3 * 2**f.depth)
    for q in range(5):  # a vector's own leaf comes before all others of its tree
        for t in range(3):
            assert whole[q][whole[q] // 2**f.depth == t][0] == own[q, t]


def test_registered_parameters_on_deep_trees(spark):
    """The query's own parameters, on clustered vectors enough for trees of depth 3 and more; queries are the ids divisible by 20."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((60, 32))[rng.integers(0, 60, 5000)] + 0.3 * rng.standard_normal((5000, 32))).astype(np.float32)
    assert forest.grow(x, len(x)).depth >= 3
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>")
    mine = {}
    for r in forest.neighbours(df, every=forest.EVERY).collect():
        mine.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert set(mine) == set(range(0, 5000, forest.EVERY))
    hit = 0
    for i, got in mine.items():
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        d[i] = np.inf
        hit += len(got & set(np.argsort(d, kind="stable")[: forest.K].tolist()))
    assert hit >= 0.9 * forest.K * len(mine)


def test_hot_cells_and_ties(spark, monkeypatch):
    """A third of the rows are one vector: their cell is cut into blocks, and the least ids win."""
    monkeypatch.setattr(forest, "CELL", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((450, 4)).astype(np.float32)
    x[:150] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {}
    for r in forest.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=5, leaf=32).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert all(got[i] == [j for j in range(6) if j != i][:5] for i in range(150))
    assert all(len(got[i]) == 5 for i in range(450))


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [float("nan"), 0.0]), (6, [1.0]), (None, [0.0, 0.0]), (2, [1.0, 0.0]), (7, [None, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("v", F.lit("x"))
    got = {(r.vec_id, r.rank): r.neighbour_id for r in forest.neighbours(df, k=2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}
    assert forest.neighbours(df.limit(0), k=2).count() == 0
    assert forest.neighbours(df.where("vec_id = 1"), k=2).count() == 0
    same = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    assert forest.neighbours(same, k=3, leaf=8).count() == 150
