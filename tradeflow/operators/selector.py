"""Which markets a feed subscribes to, and their tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pins(spark: SparkSession, ids: list[str]) -> DataFrame:
    """Operator pins as condition_id: trimmed, blanks and repeats left out."""
    own = dict.fromkeys(x.strip() for x in ids if x.strip())
    return spark.createDataFrame([(x,) for x in own], "condition_id string")


def bucketed(buckets: list[tuple[int, DataFrame, int | None]], most: int | None = None) -> DataFrame:
    """condition_id with the lowest bucket it is in. Each bucket is (number, rows (condition_id, rank_by), limit or None): it offers
    its `limit` conditions of largest rank_by, ties to the smaller id. Of all, the `most` of lowest bucket, then id, stay.

    Limits are taken per bucket before the buckets meet, and a limited bucket passes no more than its limit on."""

    def offered(number: int, rows: DataFrame, limit: int | None) -> DataFrame:
        one = rows.groupBy("condition_id").agg(F.max("rank_by").alias("rank_by"))
        one = one if limit is None else one.orderBy(F.desc_nulls_last("rank_by"), "condition_id").limit(limit)
        return one.select("condition_id", F.lit(number).alias("bucket"))

    low = reduce(DataFrame.unionByName, [offered(*b) for b in buckets]).groupBy("condition_id").agg(F.min("bucket").alias("bucket"))
    return low if most is None else low.orderBy("bucket", "condition_id").limit(most)


def tokens(snapshots: DataFrame, since=None) -> DataFrame:
    """event_id, condition_id, token, ordinal (from 0) and outcome of each market's newest active snapshot (condition_id, event_id, created_at,
    active, tokens and outcomes as JSON arrays). A token without an outcome of its place gets an empty one."""
    s = snapshots.where("active") if since is None else snapshots.where(F.col("active") & (F.col("created_at") > since))
    newest = s.groupBy("condition_id").agg(F.max_by(F.struct("event_id", "tokens", "outcomes"), F.struct("created_at", "event_id", "tokens", "outcomes")).alias("s"))
    array = lambda c: F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    d = newest.select("condition_id", F.col("s.event_id").alias("event_id"), array("s.outcomes").alias("_o"), F.posexplode(array("s.tokens")).alias("ordinal", "token"))
    return d.select("event_id", "condition_id", "token", "ordinal", F.coalesce(F.get("_o", F.col("ordinal")), F.lit("")).alias("outcome"))


def subscriptions(chosen: DataFrame, held: DataFrame) -> DataFrame:
    """Tokens of the chosen markets with their bucket, and bucket_markets, how many markets with tokens the bucket has."""
    d = held.join(chosen, "condition_id")
    first = F.row_number().over(Window.partitionBy("bucket", "condition_id").orderBy("ordinal"))
    counts = d.withColumn("_f", first).groupBy(F.col("bucket").alias("_b")).agg(F.count_if(F.col("_f") == 1).alias("bucket_markets"))
    return d.join(counts, F.col("bucket") == F.col("_b")).drop("_b")
