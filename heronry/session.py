"""A Spark session with what the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a provider's calls cost money: no task runs twice for speed
    "spark.speculation": "false",
}


def session(master: str | None = None, **config: str) -> SparkSession:
    """The active session, or a new one; a cluster's own settings win where it has them."""
    builder = SparkSession.builder.appName("heronry")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **config}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
