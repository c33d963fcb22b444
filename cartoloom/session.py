"""The session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Duplicate tag keys: the last one wins. Time zones never matter but for the stand-in queries. Filters on the kind of
#: entity reach the binary source only if Python sources may take filters over.
SETTINGS = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what can be set at run time on an existing session, and register the data sources."""
    from cartoloom.sources import register

    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    register(spark)
    return spark


def session(name: str = "cartoloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
