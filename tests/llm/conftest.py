"""Small document tables with what every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table_of(spark, texts, first=1):
    """Documents with ids from ``first`` on; a tuple gives its own id."""
    rows = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (first + k, t)
        rows.append((i, t, "en", "src", None if t is None else len(t)))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd(spark, tiny):
    """Odd rows before the small table, and columns whose names operators use inside."""
    real = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    long = " ".join(f"w{i % 977}x{i * 7919 % 10007}" for i in range(30000))
    few = table_of(spark, [(None, "a text without an id"), (9001, None), (9002, ""), (9003, " \n\t "), (9004, long), (9005, "one"), (9006, "twice " * 60), (9006, "twice " * 60), (None, None), (9007, "ü▁\U0001f600  é")])
    d = few.unionByName(real)
    for c in ("s", "key", "keys", "rep", "h1", "sketch", "group_id", "words", "start", "ids", "lens", "n", "part", "kind", "keep", "cls", "v", "bits"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
