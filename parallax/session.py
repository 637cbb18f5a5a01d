"""The SparkSession used by tests, the bench and scripts; a cluster brings its own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | None = None, memory: str = "6g") -> SparkSession:
    cpus = cpus or os.cpu_count() or 2
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parallax")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return workers_see_package(spark)


def workers_see_package(spark: SparkSession) -> SparkSession:
    """Put the repository on the import path of Python workers; on a cluster ``--py-files`` does."""
    seen = spark.sparkContext.environment
    paths = [p for p in seen.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        seen["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark
