"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(name: str = "emberlake") -> SparkSession.Builder:
    """Event time is UTC, plans adapt at run time, and overwrites replace only the partitions that are written."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
