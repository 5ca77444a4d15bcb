"""Session builder with the settings the jobs expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app_name: str = "weftline", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling switched on.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit command; ``master`` and ``cores`` serve local runs only.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master or cores:
        cores = cores or os.cpu_count() or 1
        builder = (
            builder.master(master or f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()
