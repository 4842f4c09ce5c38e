"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "monthloom", **extra: str) -> SparkSession:
    """A session with SETTINGS; master and resources come from spark-submit or from ``extra``."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | extra).getOrCreate()
