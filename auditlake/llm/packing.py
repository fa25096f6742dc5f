"""Packing texts into training sequences: cutting stock by column generation.

Token counts are rounded up to classes of ``unit`` tokens.  The linear program "fewest
sequences that hold every class's demand" has a column for each pattern of classes that fits a
sequence; columns are priced by an unbounded-knapsack dynamic program over the duals and enter a
revised simplex.  Rounded-down pattern counts are topped up while whole patterns fit the rest, what
remains is packed first-fit decreasing, and the patterns' slots are dealt to the documents
by their rank in their class.  Work on the driver depends on the number of classes only.

A document longer than a sequence gives pieces of full sequences and one of the rest.  Each piece
has the sequence's number, its first position there and its first token in the document.

Defined results: null and empty texts have no tokens and no rows; repeated rows are packed once
each; a null doc_id is packed as any other; ties in a class rank by hash, doc_id, piece; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core, subwords

CAPACITY, UNIT = 4096, 16
SCHEMA = "doc_id bigint, piece int, first_token bigint, n_tokens int, sequence bigint, position int"


# --- the linear program --------------------------------------------------------


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth that fits ``room`` units (unbounded knapsack over all rooms)."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.flatnonzero(sizes <= w)
        best[w], took[w] = best[w - 1], -1
        if len(fits):
            worth = best[w - sizes[fits]] + duals[fits]
            k = int(worth.argmax())
            if worth[k] > best[w]:
                best[w], took[w] = worth[k], fits[k]
    pattern = np.zeros(len(sizes))
    w = room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-5) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(patterns, how often each, lower bound) of the linear program, by column generation.

    Stops when no pattern prices out or Farley's bound shows that the value is within ``gap`` of the optimum.
    """
    m = len(sizes)
    columns = [np.eye(m)[i] * (room // sizes[i]) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.array([room // s for s in sizes], float))
    x = inverse @ demand
    bound = 0.0
    while True:
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            entering, c = -np.eye(m)[low], 0.0  # surplus of a class that is worth less than nothing
        else:
            worth, entering = price(np.maximum(duals, 0), sizes, room)
            value, c = float(cost @ x), 1.0
            bound = max(bound, value / max(worth, 1.0))
            if worth <= 1 + 1e-9 or value - bound <= gap * value:
                break
        step = inverse @ entering
        up = step > 1e-10
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        columns[out], cost[out] = entering, c
    used = [(p, v) for p, v, c in zip(columns, x, cost) if c > 0 and v > 1e-9]
    return [p for p, _ in used], np.array([v for _, v in used]), bound


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns (items of each class) and how often each, that hold the demand."""
    if not len(sizes):
        return []
    patterns, often, _ = solve(sizes, demand.astype(float), room)
    rest, out = demand.astype(np.int64).copy(), []
    order = np.argsort(-(often - np.floor(often)), kind="stable")
    for k, top_up in [(k, False) for k in range(len(patterns))] + [(k, True) for k in order]:
        p = patterns[k].astype(np.int64)
        on = p > 0
        most = int((rest[on] // p[on]).min())
        n = min(1 if top_up else int(np.floor(often[k] + 1e-9)), most)
        if n > 0:
            out.append((p, n))
            rest -= n * p
    bins: list[tuple[int, np.ndarray]] = []
    for c in np.argsort(-sizes, kind="stable"):  # first fit, longest first
        left = int(rest[c])
        for i, (free, p) in enumerate(bins):
            if left and free >= sizes[c]:
                n = min(left, free // int(sizes[c]))
                p[c] += n
                bins[i] = (free - n * int(sizes[c]), p)
                left -= n
        while left:
            n = min(left, room // int(sizes[c]))
            p = np.zeros(len(sizes), np.int64)
            p[c] = n
            bins.append((room - n * int(sizes[c]), p))
            left -= n
    return out + [(p, 1) for _, p in bins]


@dataclass
class Slots:
    """For each class the rank intervals of its patterns: where they begin, and how slots follow from ranks."""

    begin: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    position: dict[int, np.ndarray]
    n: int


def deal(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]], unit: int) -> Slots:
    rows: dict[int, list] = {int(s): [] for s in sizes}
    rank, base = dict.fromkeys(rows, 0), 0
    for p, n in patterns:
        at = 0
        for i in np.flatnonzero(p)[::-1]:
            s = int(sizes[i])
            rows[s].append((rank[s], int(p[i]), base, at))
            rank[s] += int(p[i]) * n
            at += int(p[i]) * s * unit
        base += n
    col = lambda k: {s: np.array([r[k] for r in v], np.int64) for s, v in rows.items()}
    return Slots(col(0), col(1), col(2), col(3), base)


# --- over documents --------------------------------------------------------------


def token_pieces(docs: DataFrame, capacity: int, unit: int, tokenizers: str) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, cls) of each piece of each document."""

    @arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(subwords.shared(tokenizers).counts(text))

    d = core.id_text(docs).select("doc_id", count("text").alias("n")).where("n > 0")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(capacity)).cast("long"))
    d = d.select("doc_id", "n", F.explode(pieces).alias("p"))
    length = F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("p") * capacity).cast("int")
    d = d.select("doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * capacity).alias("first_token"), length.alias("n_tokens"))
    return d.withColumn("cls", F.ceil(F.col("n_tokens") / F.lit(unit)).cast("int"))


def pack(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, tokenizers: str = subwords.TOKENIZERS) -> DataFrame:
    """One row for each piece, with its place."""
    spark = docs.sparkSession
    items, raw = core.table(token_pieces(docs, capacity, unit, tokenizers))
    ordered = items.select("*", F.xxhash64("doc_id", "piece").alias("h"))
    ordered = ordered.repartitionByRange("cls", "h").sortWithinPartitions("cls", "h", "doc_id", "piece").drop("h").withColumn("part", F.spark_partition_id())

    def number(batches):
        seen: dict[int, int] = {}
        for b in batches:
            cls = b.column("cls").to_numpy()
            new = np.flatnonzero(np.diff(cls, prepend=-1))
            run = np.diff(np.append(new, len(cls)))
            local = np.arange(len(cls)) - np.repeat(new, run)
            local += np.repeat([seen.get(int(c), 0) for c in cls[new]], run) if len(cls) else 0
            for c, r in zip(cls[new], run):
                seen[int(c)] = seen.get(int(c), 0) + int(r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], [*b.schema.names, "local"])

    ranked, _own = core.table(ordered.mapInArrow(number, "doc_id bigint, piece int, first_token bigint, n_tokens int, cls int, part int, local bigint"))
    core.drop_table(spark, raw)
    tally = sorted((r.cls, r.part, r.n) for r in ranked.groupBy("cls", "part").agg(F.count("*").alias("n")).collect())
    sizes = np.array(sorted({c for c, _, _ in tally}), np.int64)
    demand = np.array([sum(n for c, _, n in tally if c == s) for s in sizes], np.int64)
    slots = deal(sizes, plan(sizes, demand, capacity // unit), unit)
    before: dict[tuple[int, int], int] = {}
    run: dict[int, int] = {}
    for c, part, n in tally:
        before[c, part] = run.get(c, 0)
        run[c] = run.get(c, 0) + n

    def place(batches):
        for b in batches:
            cls, part, local = (b.column(k).to_numpy() for k in ("cls", "part", "local"))
            seq, pos = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            new = np.flatnonzero((np.diff(cls, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            for a, z in zip(new, np.append(new[1:], len(cls))):
                c = int(cls[a])
                rank = local[a:z] + before[c, int(part[a])]
                at = np.searchsorted(slots.begin[c], rank, "right") - 1
                nth = rank - slots.begin[c][at]
                seq[a:z] = slots.sequence[c][at] + nth // slots.each[c][at]
                pos[a:z] = slots.position[c][at] + nth % slots.each[c][at] * c * unit
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(seq), pa.array(pos.astype(np.int32))], ["doc_id", "piece", "first_token", "n_tokens", "sequence", "position"])

    return ranked.mapInArrow(place, SCHEMA)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
