"""Sessions for tests and benchmarks on one machine; on a cluster the caller brings the session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("treeline")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it isn't installed."""
    folder = tempfile.mkdtemp(prefix="treeline-package-")  # the driver's; executors get the file from it
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(f"{folder}/treeline", "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
