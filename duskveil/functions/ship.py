"""Shipping the package to the executors, and the bound of Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Most bytes of one Arrow batch handed to Python; one row may be larger.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors (once an application) and bounds Arrow batches by bytes."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        to = Path(tempfile.mkdtemp()) / "duskveil_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted((root / "duskveil").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
