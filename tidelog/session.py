"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps and adaptive execution; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
