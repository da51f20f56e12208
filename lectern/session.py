"""Spark session with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and partitions are left to the cluster if not given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
