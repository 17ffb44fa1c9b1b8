"""Shared pieces of the training-data operators: scratch tables and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeflow.sources.scratch import kept, scratch

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one, removed when the driver's JVM ends."""
    return scratch(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and
    a lost executor costs a reread, not a recomputation."""
    return kept(df)


#: Ids of a broadcast: some 60 bytes each where they are looked up.
MOST_IDS = 2_000_000


def ids_of(d: DataFrame) -> DataFrame:
    """The distinct rows of d, ids alone, written once; broadcast where they are at most MOST_IDS, so that what they select is not sent."""
    d = cut(d.distinct())
    return F.broadcast(d) if d.count() <= MOST_IDS else d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def distributed_rank(df: DataFrame, groups: list[str], order: list[str], bucket: Column, out: str, weight: str | None = None) -> DataFrame:
    """Gapless 0-based rank within each group, or with `weight` the sum of the weights before the row.

    A group may hold any share of the rows: rows are ranked within (group, bucket), and the
    start of each bucket comes from a prefix sum over bucket totals, which are few.
    `order` must be unique within a bucket. The order over buckets is that of `bucket`.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    d = df.withColumn("_b", bucket).withColumn("_w", w)
    keys = [*groups, "_b"]
    totals = d.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = before.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long")))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.coalesce(F.sum("_w").over(within), F.lit(0).cast("long")))
    cond = F.col("_b").eqNullSafe(F.col(f"_k{len(keys) - 1}"))
    for i, k in enumerate(groups):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(starts, cond).select(*df.columns, (F.col("_local") + F.col("_start")).alias(out))
