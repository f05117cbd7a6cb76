"""A session with the settings the plans want; on a cluster the submitted ones hold."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application: they may have neither its folder nor its path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folioscan")) / "folioscan.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def session(master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("folioscan")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    if master or not os.environ.get("SPARK_MASTER_URL"):
        builder = builder.master(master or f"local[{cores}]").config("spark.driver.memory", os.environ.get("FOLIOSCAN_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cores)
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
