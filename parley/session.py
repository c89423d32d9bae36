"""Sessions with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "parley", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings and ``settings`` take precedence."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
