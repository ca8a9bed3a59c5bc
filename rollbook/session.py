"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package's modules to the executors, once per application, as any Spark application ships its code."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped_to:
        return
    fd, name = tempfile.mkstemp(prefix="rollbook-", suffix=".zip")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(name)
    _shipped_to.add(sc.applicationId)


def local_session(app: str = "rollbook", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROLLBOOK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
