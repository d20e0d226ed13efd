"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "abundara", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; partition counts stay with the cluster's configuration unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
