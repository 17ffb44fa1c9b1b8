"""Runs of rows within keys of any size, and what can be done run by run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.operators.asof import asof
from tradeflow.operators.ranks import days
from tradeflow.sources.scratch import kept


def _beside(d: DataFrame, marks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """d with columns of marks by keys and bucket, nulls meeting nulls."""
    m = marks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_bucket"])], *columns)
    same = F.lit(True)
    for i, k in enumerate([*keys, "_bucket"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(m, same).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def islands(d: DataFrame, keys: list[str], order: list[str], bucket: Column, seen: list[str], starts: Callable[[Column], Column]) -> DataFrame:
    """Adds _island, the `order` columns (a struct) of the first row of the run that a row is in, and _prior, the `seen` columns of
    the row before it (null for the key's first).

    A row starts a run when it is the key's first or starts(p) holds, p being the `seen` columns of the row before it. A key
    is cut into buckets, in the order of `order`; what the buckets before end with is carried over by windows over a row a bucket.
    d is read several times, so it is written once first."""
    d0 = kept(d.withColumn("_bucket", bucket))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    place, row = F.struct(*order), F.struct(*seen)
    ends = d0.groupBy(*keys, "_bucket").agg(F.max_by(row, place).alias("_end")).withColumn("_end", F.lag("_end").over(earlier))
    d0 = _beside(d0.withColumn("_before", F.lag(row).over(w)), ends, keys, ["_end"])
    before = F.coalesce("_before", "_end")
    d0 = d0.withColumn("_start", F.when(before.isNull() | F.coalesce(starts(before), F.lit(False)), place))
    firsts = d0.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_first")).withColumn("_first", F.max("_first").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    d0 = d0.withColumn("_own", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _beside(d0, firsts, keys, ["_first"]).select(*d.columns, F.coalesce("_own", "_first").alias("_island"), before.alias("_prior"))


def quiet_cut(d: DataFrame, key: str, at: str, quiet: str, bucket_days: int = 30) -> DataFrame:
    """Adds _island, a new one after every gap of more than `quiet` (an interval) between a key's rows: for walks that keep nothing
    over such a gap, the islands of a key can be walked side by side."""
    return islands(d, [key], [at], days(at, bucket_days), [at], lambda p: F.col(at) > p[at] + F.expr(f"INTERVAL {quiet}")).drop("_prior")


def semantic_gate(d: DataFrame, key: str, at: str, code: str, tie: list[str], cooldown_s: int, bucket_days: int = 30) -> DataFrame:
    """Adds allowed and reason: no_prior_semantic, semantic_changed, cooldown_elapsed or cooldown_active.

    A row is allowed when the last allowed row of its key had another code or lies cooldown_s or more back; allowing it resets
    both. Rows of one code in a row are a run; its first row is allowed, and so is any after a pause of the cool-down. Which others
    are depends on those allowed before: the next allowed row after each row is found by an as-of join, and the rows that
    such jumps reach from a run's first by doubling, jumps of 1, 2, 4 and so on: as many joins as the logarithm of
    the longest chain, and no key is walked. Rows of one time and code count as one: the first by `tie` is the allowed one."""
    wait = F.expr(f"INTERVAL {cooldown_s} SECONDS")
    d0 = islands(d, [key], [at, *tie], days(at, bucket_days), [at, code], lambda p: ~F.col(code).eqNullSafe(p[code]) | (F.col(at) >= p[at] + wait))
    d0 = kept(d0.withColumns({"_run": F.struct(F.col(key).alias("k"), F.col("_island")), "_when": F.col(at), "_tie": F.struct(*tie)}))
    # Nodes: the times of a run; _to: the first time of the run at which a row after one allowed here may be allowed.
    nodes = d0.groupBy("_run", "_when").agg(F.min("_tie").alias("_tie")).withColumn("_due", F.col("_when") + wait)
    later = nodes.select("_run", F.col("_when").alias("_u"), F.col("_when").alias("_to"))
    jumps = kept(asof(nodes, later, ["_run"], "_due", "_u", ["_to"], "forward", bucket_days=bucket_days).select("_run", "_when", "_to").where("_to is not null"))
    reached = kept(d0.groupBy("_run").agg(F.min("_when").alias("_when")))
    while jumps.limit(1).count():
        reached = kept(reached.unionByName(reached.join(jumps, ["_run", "_when"]).select("_run", F.col("_to").alias("_when"))))
        second = jumps.select(F.col("_run").alias("_run2"), F.col("_when").alias("_when2"), F.col("_to").alias("_to2"))
        jumps = kept(jumps.join(second, (F.col("_run") == F.col("_run2")) & (F.col("_to") == F.col("_when2"))).select("_run", "_when", F.col("_to2").alias("_to")))
    allowed = reached.join(nodes.select("_run", "_when", "_tie"), ["_run", "_when"]).select(F.col("_run").alias("_r"), F.col("_when").alias("_at"), F.col("_tie").alias("_first"))
    d0 = d0.join(allowed, (F.col("_run") == F.col("_r")) & (F.col("_when") == F.col("_at")) & (F.col("_tie") == F.col("_first")), "left")
    reason = F.when(F.col("_first").isNull(), "cooldown_active").when(F.col("_prior").isNull(), "no_prior_semantic").when(~F.col(f"_prior.{code}").eqNullSafe(F.col(code)), "semantic_changed").otherwise("cooldown_elapsed")
    return d0.select(*d.columns, F.col("_first").isNotNull().alias("allowed"), reason.alias("reason"))
