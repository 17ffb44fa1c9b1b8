"""What a decision may read of inputs that are loaded from time to time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.operators.asof import asof


def staged(decisions: DataFrame, inputs: DataFrame, by: list[str], at: str, loaded_at: str, columns: list[str], order: list[Column], ttl: str, most: int, bucket_days: int = 365) -> DataFrame:
    """decisions with loaded_at, state and rows of the newest input loaded at or before `at`.

    An input of a key is all its rows of one loaded_at. state is fresh where it is at most `ttl` (an interval) old, stale where it is
    older, and missing where none was loaded yet; only a fresh one is read: its first `most` rows by `order`, as an array of
    `columns`. Rows of an input are cut before they are gathered, so an array holds `most` at most, and the as-of
    join carries one time a decision, not its rows."""
    top = Window.partitionBy(*by, loaded_at).orderBy(*order)
    first = inputs.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most)
    arrays = first.groupBy(*by, F.col(loaded_at).alias("_l")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("_rows"))
    versions = inputs.select(*by, F.col(loaded_at).alias("_u"), F.col(loaded_at).alias("_l")).distinct()
    d = asof(decisions, versions, by, at, "_u", ["_l"], bucket_days=bucket_days)
    state = F.when(F.col("_l").isNull(), "missing").when(F.col(at) <= F.col("_l") + F.expr(f"INTERVAL {ttl}"), "fresh").otherwise("stale")
    d = d.withColumn("state", state).join(arrays, [*by, "_l"], "left")
    return d.select(*decisions.columns, F.col("_l").alias("loaded_at"), "state", F.when(F.col("state") == "fresh", F.col("_rows")).alias("rows"))
