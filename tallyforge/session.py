"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", **conf: str) -> SparkSession:
    """Get or make a session: UTC, adaptive plans, and filters pushed to Python sources."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
