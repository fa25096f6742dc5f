"""Every query with SQL against DuckDB over the same tables; every other one runs."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from auditlake.plans import catalogue


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def db(tiny):
    c = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tiny, db, name):
    df = catalogue.QUERIES[name](spark, tiny)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalogue.ORACLE:
        assert rows
        return
    got = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(norm(r[k]) for k in order) for r in got.fetchall()), key=str)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=str)
    assert len(mine) == len(want), (len(mine), len(want), [x for x in mine if x not in want][:3], [x for x in want if x not in mine][:3])
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    assert not bad, bad[:3]
