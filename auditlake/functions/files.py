"""Python steps that read one file at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of_files(files: DataFrame, schema: str, rows_of: Callable[..., Iterable[tuple]], *columns: str) -> DataFrame:
    """The rows, of ``schema``, that ``rows_of`` gives for ``columns`` of each file.

    A worker gets files by the hundred at most, pickled, and not in Arrow batches of 10,000, which it would hold
    as Arrow, as pandas and as rows at once; it needs neither library.
    """
    each = F.udf(lambda *x: list(rows_of(*x)), f"array<struct<{schema}>>", useArrow=False)
    return files.select(F.inline(each(*columns)))
