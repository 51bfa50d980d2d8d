"""Session settings that every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "gridspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew-join splitting; shuffle partitions are left to the cluster and coalesced at run time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
