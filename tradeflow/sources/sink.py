"""Append-only tables as Parquet, one partition a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Adds a batch to the table at path. A batch that is written again, after a lost driver or a redelivery,
    replaces itself and nothing else, so every row is there once."""
    out = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)
