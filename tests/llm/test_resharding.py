"""Resharding against enumeration of all assignments, and the rewritten files against the old ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import resharding
from tests.llm.conftest import table_of


def cheapest(sizes, capacities):
    """Fewest blocks that move, over all ways to split every shard's blocks."""
    def splits(n, m):
        return [x for x in itertools.product(range(n + 1), repeat=m) if sum(x) == n]

    best = None
    for choice in itertools.product(*[splits(s, len(capacities)) for s in sizes]):
        if all(sum(c[j] for c in choice) <= capacities[j] for j in range(len(capacities))):
            moved = sum(c[j] for i, c in enumerate(choice) for j in range(len(capacities)) if i != j)
            best = moved if best is None else min(best, moved)
    return best


@pytest.mark.parametrize("sizes,capacities", [([3, 1, 2], [2, 2, 2]), ([4], [1, 1, 2]), ([2, 3], [5]), ([0, 4, 1], [3, 2, 0]), ([1, 1, 1], [3, 3, 3]), ([5, 0], [2, 4]), ([], [3])])
def test_flow_moves_the_fewest_blocks(sizes, capacities):
    flow = resharding.solve(sizes, capacities)
    assert [sum(f.values()) for f in flow] == sizes
    assert all(sum(f.get(j, 0) for f in flow) <= c for j, c in enumerate(capacities))
    assert sum(n for i, f in enumerate(flow) for j, n in f.items() if i != j) == (cheapest(sizes, capacities) or 0)


def test_too_little_room():
    with pytest.raises(ValueError):
        resharding.solve([3], [1, 1])


def test_files_are_rewritten(spark, odd, tmp_path):
    path = str(tmp_path / "t.parquet")
    odd.repartitionByRange(5, "doc_id").write.parquet(path)
    longest = odd.agg(F.max(F.octet_length("text"))).head()[0]
    total = odd.agg(F.sum(F.octet_length("text"))).head()[0]
    cap = max(4 * longest, total // 3)
    manifest, folder, left = resharding.reshard(spark, path, [cap] * 6, unit_bytes=1 << 12)
    m = manifest.collect()
    assert len(m) == odd.count()
    new = spark.read.parquet(folder) if any(r.moved for r in m) else odd.limit(0)
    kept = spark.read.parquet(*[f"{path}/{f}" for f in left]) if left else odd.limit(0)
    key = lambda d: sorted((str(r.doc_id), r.text or "", r.s) for r in d.select("doc_id", "text", "s").collect())
    assert sorted(key(new) + key(kept)) == key(odd)
    size = {r[0]: r[1] for r in new.groupBy("__al_new_shard").agg(F.sum(F.octet_length("text"))).collect()} if any(r.moved for r in m) else {}
    assert all((v or 0) <= cap for v in size.values())
    files = [f.rsplit("/", 2)[1] for f in new.inputFiles()] if any(r.moved for r in m) else []
    assert len(files) == len(set(files)) == len({r.new_shard for r in m if r.shard.startswith(folder)})
    assert {r.shard.rsplit("/", 1)[1] for r in m if not r.shard.startswith(folder)} == set(left)


def test_long_texts_at_default_capacities(spark, tmp_path):
    """Texts of 300 KB and 9 MB beside short ones: places for all, and no shard beyond what the defaults give."""
    texts = ["x" * 20_000] * 400 + ["y" * 300_000, "z" * 9_000_000, None]
    path = str(tmp_path / "t.parquet")
    table_of(spark, texts).coalesce(1).write.parquet(path)
    manifest, folder, _ = resharding.reshard(spark, path, shard_bytes=4 << 20)
    m = manifest.collect()
    assert len(m) == 403 and sorted(r.row for r in m) == list(range(403))
    size = {}
    for r in m:
        size[r.new_shard] = size.get(r.new_shard, 0) + len(texts[r.doc_id - 1] or "")
    assert all(v <= (4 << 20) for v in size.values() if v < 9_000_000) and spark.read.parquet(folder).count() == 403


def test_empty_table(spark, none, tmp_path):
    path = str(tmp_path / "e.parquet")
    none.write.parquet(path)
    manifest, _, _ = resharding.reshard(spark, path)
    assert manifest.count() == 0


def test_whole_table(spark, small):
    got = resharding.query(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count() and got.where("new_shard IS NULL").count() == 0


def least_bytes(weights, capacities):
    """Fewest bytes that move, over all assignments of whole blocks; None if none fits."""
    flat, best = [(i, w) for i, ws in enumerate(weights) for w in ws], None
    for to in itertools.product(range(len(capacities)), repeat=len(flat)):
        if all(sum(w for (_, w), j in zip(flat, to) if j == k) <= c for k, c in enumerate(capacities)):
            moved = sum(w for (i, w), j in zip(flat, to) if i != j)
            best = moved if best is None else min(best, moved)
    return best


@pytest.mark.parametrize("weights,capacities", [([[7, 3, 5], [2, 2]], [11, 9, 9]), ([[9, 8, 2, 1]], [16, 10]), ([[30], [4, 4, 3]], [8, 8, 40]), ([[6, 5, 5], [1]], [10, 1, 6]), ([[3, 3], [], [5]], [6, 5]), ([[100, 1, 1, 2]], [4, 100]), ([[], []], [1])])
def test_whole_blocks_move_the_fewest_bytes(weights, capacities):
    got = resharding.assign(weights, capacities)
    assert [len(g) for g in got] == [len(w) for w in weights]
    assert all(sum(w for ws, g in zip(weights, got) for w, j in zip(ws, g) if j == k) <= c for k, c in enumerate(capacities))
    assert sum(w for i, (ws, g) in enumerate(zip(weights, got)) for w, j in zip(ws, g) if j != i) == least_bytes(weights, capacities)


def test_default_capacities_hold_any_blocks():
    rng = random.Random(4)
    for _ in range(200):
        weights = [[rng.choice([0, 1, 3, 7, 8, 9, 15, 16, 17, 60]) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 6))]
        assert resharding.assign(weights, resharding.default_capacities(weights, 16)) is not None


def test_files_that_fit_stay_beside_a_huge_text(spark, tmp_path):
    texts = ["x" * 100] * 140 + ["y" * 1500]
    path = str(tmp_path / "t.parquet")
    table_of(spark, texts).coalesce(1).write.parquet(path)
    manifest, _, left = resharding.reshard(spark, path, [15_500], unit_bytes=1000)
    assert len(left) == 1 and manifest.where("moved").count() == 0
    manifest, _, _ = resharding.reshard(spark, path, unit_bytes=1000, shard_bytes=1200)
    at = {r.doc_id: r.new_shard for r in manifest.collect()}
    assert len(at) == 141 and len({j for i, j in at.items() if i != 141} & {at[141]}) == 0
    # the text that is longer than its shards can't stay, and of the others the first shard keeps what it holds
    assert sum(100 for i, j in at.items() if i != 141 and j == 0) > 600
