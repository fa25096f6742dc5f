"""Watching a folder: a file stream, checks of each micro-batch, and what changed since the batch before.

Events within a trigger's interval meet in one micro-batch; none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.functions.lines import extension
from auditlake.operators.compare import report_diff

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, path: str, exts: list[str], per_trigger: int = 1000) -> DataFrame:
    """A stream of (file, source) of new and changed files."""
    d = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    file = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    return d.where(extension(file).isin(exts)).select(file.alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("source"), "modificationTime").where("source IS NOT NULL")


def watch(stream: DataFrame, checks: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, interval: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Runs ``checks`` (files -> (name, passed)) on each micro-batch and writes what changed as Parquet below ``state``.

    ``state/results/batch=N`` has batch N's results and ``state/changes/batch=N`` the difference from the batch before; a batch that runs
    again after a failure overwrites its own folders only.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = f"{state}/results/batch={n}"
        checks(batch).select("name", "passed").write.mode("overwrite").parquet(now)
        results = spark.read.schema("name string, passed boolean").parquet(now)
        before = spark.read.schema("name string, passed boolean").parquet(f"{state}/results/batch={n - 1}") if n else results.limit(0)
        report_diff(before, results).where("change IN ('fixed', 'broken', 'new')").write.mode("overwrite").parquet(f"{state}/changes/batch={n}")

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows over (ts, event_type, value), batch or stream; later events than the watermark are dropped."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
