"""Resharding by minimum-cost flow.

Old shards are the files of a table; new shards are capacities in text bytes.  New shard i is old
shard i carried on, so what stays costs nothing and what goes elsewhere costs its bytes.  Rows are
cut into blocks of at most one unit each, and a text of over half a unit is a block of its own.  The flow network
source -> old shards -> new shards -> sink carries bytes and is solved by successive shortest paths (Dijkstra with
potentials); all moves of a byte cost alike, so they share a hub vertex and the network has a few edges a shard.
Then ``assign`` rounds the flow to whole blocks: a file that fits its shard stays whole, of any other the blocks
that fill its shard best stay, and the rest go where the flow sends them or else where they fit best.  If blocks don't fit so, they
are cut smaller, down to single rows.  The driver holds the weight and first row of each block.
Rows find their places by binary search among runs of blocks with one destination: one run a file that stays whole, and few of
any other, so what goes to the workers grows with the files and with what moves, not with the rows.  Shards that lose or
gain a block are rewritten below a folder of their own, one file each, by one shuffle of their rows alone; all others stay as they are.

Defined results: a null text weighs 0 bytes; repeated rows are rows like any other, and a null doc_id and
further columns go along unchanged; an empty table has no blocks and gives an empty result; a total capacity below
the need, or rows for which no place is found, raise ValueError; no block parts and no new shard exceeds its capacity.
"""

from __future__ import annotations

import bisect
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core

#: A block's and a new shard's bytes in the registered query.
UNIT_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
#: Of a file that its shard doesn't hold, the choice among so many lightest blocks is exact.
EXACT = 14


def solve(sizes: list[int], capacities: list[int]) -> list[dict[int, int]]:
    """For each old shard the bytes (or any units) that go to each new shard; the fewest leave their place."""
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError(f"{sum(sizes)} bytes don't fit capacities of {sum(capacities)}")
    source, sink, hub = n + m, n + m + 1, n + m + 2
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n + m + 3)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            edges[x].append(len(to))
            to.append(y), room.append(z), cost.append(v)
        return len(to) - 2

    stays, leaves, gains = {}, [], []
    for i, s in enumerate(sizes):
        edge(source, i, s, 0)
        if i < m:
            stays[i] = edge(i, n + i, s, 0)
        leaves.append(edge(i, hub, s, 1))
    for j, c in enumerate(capacities):
        gains.append(edge(hub, n + j, c, 0))
        edge(n + j, sink, c, 0)
    height, need = [0] * len(edges), sum(sizes)
    while need:
        dist: list[float] = [math.inf] * len(edges)
        via = [-1] * len(edges)
        dist[source] = 0
        heap: list[tuple[float, int]] = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if u == sink:
                break
            if d > dist[u]:
                continue
            for e in edges[u]:
                if room[e]:
                    far = d + cost[e] + height[u] - height[to[e]]
                    if far < dist[to[e]]:
                        dist[to[e]], via[to[e]] = far, e
                        heapq.heappush(heap, (far, to[e]))
        limit = dist[sink]
        height = [h + int(min(d, limit)) for h, d in zip(height, dist)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(min(room[e] for e in path), need)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        need -= push
    flow: list[dict[int, int]] = [{i: room[stays[i] ^ 1]} if i in stays and room[stays[i] ^ 1] else {} for i in range(n)]
    free, j = [room[e ^ 1] for e in gains], 0
    for i in range(n):  # take the hub's flow apart
        left = room[leaves[i] ^ 1]
        while left:
            while not free[j]:
                j += 1
            k = min(left, free[j])
            flow[i][j] = flow[i].get(j, 0) + k
            left -= k
            free[j] -= k
    return flow


def fullest(weights: list[int], room: int) -> set[int]:
    """Numbers of blocks of at most ``room`` bytes together, as many bytes as can be: heavy ones first, and of the last ``EXACT`` the best choice.

    The heavy ones leave half of the last ones' bytes free, so that there is much to choose from, or no bytes if that holds more.
    """
    order = sorted(range(len(weights)), key=lambda k: (-weights[k], k))
    best: tuple[int, set[int]] = (-1, set())
    for spare in {sum(weights[k] for k in order[-EXACT:]) // 2, 0}:
        keep, free = set(), room
        for k in order[:-EXACT]:
            if weights[k] <= free - spare:
                keep.add(k)
                free -= weights[k]
        sums: dict[int, tuple[int, int]] = {0: (0, -1)}  # reachable sum: the sum before its last block, and that block
        for k in order[-EXACT:]:
            for s in list(sums):
                if weights[k] and s + weights[k] <= free:
                    sums.setdefault(s + weights[k], (s, k))
        at = max(sums)
        free -= at
        while at:
            at, k = sums[at]
            keep.add(k)
        for k in order:
            if k not in keep and weights[k] <= free:
                keep.add(k)
                free -= weights[k]
        best = max(best, (room - free, keep), key=lambda x: x[0])
    return best[1]


def assign(weights: list[list[int]], capacities: list[int]) -> list[list[int]] | None:
    """The new shard of each block of each old shard, or None if blocks find no place."""
    flow = solve([sum(w) for w in weights], capacities)

    def placed(stay: list[set[int]]) -> list[list[int]] | None:
        out = [[i] * len(w) for i, w in enumerate(weights)]
        free = [c - (sum(weights[j][k] for k in stay[j]) if j < len(weights) else 0) for j, c in enumerate(capacities)]
        rooms = sorted((f, j) for j, f in enumerate(free))
        for w, i, k in sorted(((w, i, k) for i, ws in enumerate(weights) for k, w in enumerate(ws) if k not in stay[i]), key=lambda b: (-b[0], *b[1:])):
            j = next((j for j in [i, *sorted(flow[i])] if j < len(free) and free[j] >= w), None)
            if j is None:
                at = bisect.bisect_left(rooms, (w, -1))
                if at == len(rooms):
                    return None
                j = rooms[at][1]
            rooms.pop(bisect.bisect_left(rooms, (free[j], j)))
            free[j] -= w
            bisect.insort(rooms, (free[j], j))
            out[i][k] = j
        return out

    stay = [set(range(len(w))) if i < len(capacities) and sum(w) <= capacities[i] else fullest(w, capacities[i]) if i < len(capacities) else set() for i, w in enumerate(weights)]
    return placed(stay) or placed([set() for _ in weights])


def default_capacities(weights: list[list[int]], shard_bytes: int) -> list[int]:
    """Shards that hold the blocks with a fifth to spare, whatever their weights are.

    A block of at most half a shard finds room as long as the others leave it on average; each heavier one has a further shard.
    """
    total, all_ = sum(map(sum, weights)), [w for ws in weights for w in ws]
    light = max((w for w in all_ if 2 * w <= shard_bytes), default=0)
    n = max(1, len(weights), math.ceil(1.2 * total / shard_bytes), math.ceil(total / (shard_bytes - light)) + 1 if total else 0)
    return [shard_bytes] * n + [max(shard_bytes, w) for w in sorted(all_, reverse=True) if 2 * w > shard_bytes]


def reshard(spark: SparkSession, path: str, capacities: list[int] | None = None, unit_bytes: int = UNIT_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str, list[str]]:
    """(manifest, folder of rewritten shards, files left as they are).

    The manifest has (doc_id, old_shard, new_shard, row, moved, shard) of every row: its number in its old file, and the file or folder
    that holds it now.  The folder has ``__al_new_shard=N`` with the whole of each affected new shard as one file.  Capacities default to
    shards of ``shard_bytes``, or of a longer text.
    """
    docs = spark.read.parquet(path)
    names = sorted(f.rsplit("/", 1)[-1] for f in docs.inputFiles())
    file, row = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), F.col("_metadata.row_index")
    light, light_path = core.table(docs.select(file.alias("file"), row.alias("row"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")))
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    number, unit = {f: i for i, f in enumerate(names)}, unit_bytes
    while True:
        half = max(1, unit // 2)
        long = F.col("bytes") > half
        # Both terms only grow along a file: a long text ends the block before it and begins one after it, and short
        # texts that begin in the same half of a unit make a block, which so weighs at most a unit.
        nth = 2 * F.coalesce(F.count_if(long).over(before), F.lit(0)) + long.cast("long") + F.floor(F.coalesce(F.sum(F.when(long, 0).otherwise(F.col("bytes"))).over(before), F.lit(0)) / F.lit(half))
        blocks = light.select("file", "row", "bytes", nth.alias("block")).groupBy("file", "block").agg(F.min("row").alias("first_row"), F.sum("bytes").alias("weight")).toArrow().sort_by([("file", "ascending"), ("block", "ascending")])
        weights: list[list[int]] = [[] for _ in names]
        old = [number[f] for f in blocks.column("file").to_pylist()]
        for i, w in zip(old, blocks.column("weight").to_pylist()):
            weights[i].append(w)
        room = default_capacities(weights, shard_bytes) if capacities is None else capacities
        places = assign(weights, room)
        if places is not None:
            break
        if unit <= 1:
            raise ValueError(f"no place found for all rows in capacities of {sum(room)} bytes")
        unit = max(1, unit // 16)
    core.drop_table(spark, light_path)
    new, old_of, first_row = np.array([j for p in places for j in p], np.int64), np.array(old, np.int64), blocks.column("first_row").to_numpy()
    begins = np.ones(len(new), bool)
    begins[1:] = (np.diff(old_of) != 0) | (np.diff(new) != 0)
    code, to = (old_of[begins] << 40) + first_row[begins], new[begins].astype(np.int32)
    touched = {x for i, p in enumerate(places) for j in p if j != i for x in (i, j)}
    left = [f for i, f in enumerate(names) if i not in touched and weights[i]]
    number_of = F.broadcast(spark.createDataFrame([(f, i) for f, i in number.items()], "__al_file string, __al_old int"))  # a row for each file

    @arrow_udf("int")
    def place(file_number: pa.Array, row_number: pa.Array) -> pa.Array:
        at = (file_number.to_numpy().astype(np.int64) << 40) + row_number.to_numpy()
        return pa.array(to[np.searchsorted(code, at, "right") - 1])

    def placed(columns: list) -> DataFrame:
        base = docs.select(*columns, file.alias("__al_file"), row.alias("__al_row")).join(number_of, "__al_file")
        return base.withColumn("__al_new_shard", place.asNondeterministic()("__al_old", "__al_row"))

    folder = f"{core.shared_dir(spark)}/auditlake-shards-{uuid.uuid4().hex}"
    if touched:
        own = [F.col(f"`{c}`") for c in docs.columns]
        affected = spark.createDataFrame([(j,) for j in sorted(touched)], "__al_new_shard int")
        rewritten = placed(own).join(F.broadcast(affected), "__al_new_shard", "left_semi")
        rewritten = rewritten.repartition("__al_new_shard").sortWithinPartitions("__al_new_shard", "__al_old", "__al_row")
        rewritten.select(*own, "__al_new_shard").write.partitionBy("__al_new_shard").parquet(folder)
    where = F.when(F.col("__al_new_shard").isin(sorted(touched)), F.concat(F.lit(f"{folder}/__al_new_shard="), F.col("__al_new_shard"))) if touched else F.lit(None).cast("string")
    manifest = placed([F.col("doc_id").cast("long").alias("doc_id")]).select(
        "doc_id", F.col("__al_old").alias("old_shard"), F.col("__al_new_shard").alias("new_shard"), F.col("__al_row").alias("row"), (F.col("__al_new_shard") != F.col("__al_old")).alias("moved"),
        F.coalesce(where, F.concat(F.lit(f"{path.rstrip('/')}/"), F.col("__al_file"))).alias("shard"),
    )
    return manifest, folder, left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(spark, f"{sf_dir}/documents.parquet")[0]
