"""Session settings; each can be overridden by the caller or the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "millrace", **settings: str) -> SparkSession:
    """A session with adaptive execution; ``settings`` are Spark's own, given as ``**{"spark...": "..."}``.

    Locally there are as many shuffle partitions as cores.  On a cluster the number is left to the
    cluster's own setting, which adaptive execution then coalesces to the data.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "spark.sql.shuffle.partitions" not in settings:
            cores = master[6:-1] if master.startswith("local[") else "1"
            builder = builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() if cores == "*" else cores))
    return builder.getOrCreate()
