"""Packing: prices and programs against enumeration, places against their invariants."""

import itertools

import numpy as np
import pyarrow as pa

from auditlake.llm import packing, subwords
from tests.llm.conftest import table_of


def test_price_is_the_best_pattern():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, room = np.sort(rng.choice(np.arange(2, 9), 3, replace=False)), 20
        duals = rng.random(3)
        worth, pattern = packing.price(duals, sizes, room)
        best = max(np.dot(duals, p) for p in itertools.product(*[range(room // s + 1) for s in sizes]) if np.dot(sizes, p) <= room)
        assert abs(worth - best) < 1e-9 and abs(np.dot(duals, pattern) - best) < 1e-9 and np.dot(sizes, pattern) <= room


def test_plan_holds_the_demand_near_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 65)
    demand = rng.integers(1, 400, 64)
    done = packing.plan(sizes, demand, 64)
    assert np.array_equal(sum(p * n for p, n in done), demand) and all(np.dot(p, sizes) <= 64 for p, _ in done)
    used, bound = sum(n for _, n in done), packing.solve(sizes, demand.astype(float), 64)[2]
    assert np.dot(sizes, demand) / 64 <= bound + 1e-6 and bound <= used <= 1.005 * bound + 8
    assert packing.plan(np.zeros(0, int), np.zeros(0, int), 64) == []


def check(rows, texts, capacity):
    """Every token has one place, none has two."""
    n = dict(zip(texts, subwords.shared().counts(pa.array(list(texts.values()))).tolist()))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence, []).append(r)
        assert 0 < r.n_tokens <= capacity and r.position + r.n_tokens <= capacity
    assert set(by_doc) == {i for i, k in n.items() if k}
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.first_token for r in own] == [capacity * k for k in range(len(own))] and sum(r.n_tokens for r in own) == n[i]
    for own in by_seq.values():
        own.sort(key=lambda r: r.position)
        assert all(a.position + a.n_tokens <= b.position for a, b in zip(own, own[1:]))
    return len(by_seq), sum(n.values())


def test_documents_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs).collect()
    sequences, tokens = check(rows, {r.doc_id: r.text for r in docs.collect()}, packing.CAPACITY)
    assert tokens / (sequences * packing.CAPACITY) > 0.95


def test_odd_rows(spark, odd, none):
    rows = packing.pack(odd, capacity=512, unit=8).collect()
    assert {r.doc_id for r in rows} >= {None, 9003, 9004, 9005, 9006} and not {r.doc_id for r in rows} & {9001, 9002}
    assert len([r for r in rows if r.doc_id == 9006]) == 2
    places = [(r.sequence, r.position) for r in rows]
    assert len(places) == len(set(places))
    assert packing.pack(none).count() == 0
    same = packing.pack(table_of(spark, ["same text"] * 500), capacity=64, unit=2).collect()
    assert len(same) == 500 and len({(r.sequence, r.position) for r in same}) == 500
