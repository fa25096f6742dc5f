"""The package on the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_auditlake_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="auditlake-py-")) / "auditlake.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((root / "auditlake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(at))
    sc._auditlake_shipped = True
