"""The corpus pipeline: documents in, places of their token pieces in packed sequences out.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import core, langid, nearcopies, packing, quality, repeats

STAGES = [
    ("quality rules", quality.kept),
    ("language ID", langid.kept),
    ("n-gram Jaccard join", nearcopies.one_of_each),
    ("substring dedup", repeats.without_repeats),
    ("packing", packing.packed),
]

#: Boosted trees, context trees and a suffix index can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    core.ship(spark)
    docs, behind = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs, path = core.table(out)
        if behind:
            core.drop_table(spark, behind)
        behind = path
    return docs
