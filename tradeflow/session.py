"""Session settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("tradeflow").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false")
    return b.config(map={**SETTINGS, **settings}).getOrCreate()
