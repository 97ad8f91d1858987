"""A session with the settings that the queries are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loadscope", **extra: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, the last of repeated JSON keys; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.variant.allowDuplicateKeys", "true")
    for k, v in extra.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
