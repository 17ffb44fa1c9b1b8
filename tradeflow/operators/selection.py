"""Exact percentiles of a few groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.sources.scratch import kept

#: Parts that a range of values is cut into by one pass.
PARTS = 1_024


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Which part of [lo, hi] a value lies in, never falling as v grows.

    A range over zero is cut by sign; one whose ends differ much in size by logarithm, so that no distribution needs more than some ten
    passes; others evenly."""
    log = lambda x: F.log2(F.abs(x))
    share = lambda x, a, b: F.least(F.floor((x - a) / (b - a) * PARTS), F.lit(PARTS - 1))
    wide = lambda a, b: F.abs(b) / F.abs(a) > PARTS
    part = F.when((lo < 0) & (hi > 0) | (lo == 0) | (hi == 0), F.signum(v)).when((lo > 0) & wide(lo, hi), share(log(v), log(lo), log(hi)))
    return part.when((hi < 0) & wide(hi, lo), -share(log(v), log(hi), log(lo))).otherwise(share(v, lo, hi)).cast("long")


def percentiles(d: DataFrame, keys: list[str], column: str, quantiles: tuple[float, ...], limit: int = 20_000) -> DataFrame:
    """A row for each group: its keys, n (values) and q, the interpolated quantiles of its values; nulls are no values, a group
    without values gives no row. Values must be finite.

    The ranks that are asked for are looked up. A pass cuts the value range around them into parts, counts each part
    map-side and goes on with those parts that hold a wanted rank, until a part holds one value or at most `limit` rows;
    only these are gathered, so no buffer grows with a group. Made for few groups of any size: what is passed from
    pass to pass is two ranges a quantile and group."""
    names = [f"_k{i}" for i in range(max(1, len(keys)))]  # one group of all rows has a key too
    own = [F.col(k).alias(n) for k, n in zip(keys, names, strict=False)] or [F.lit(0).alias(names[0])]
    small_side = (lambda r: r) if keys else F.broadcast  # without keys it is two rows a quantile at most; else Spark goes by its size
    v = kept(d.where(F.col(column).isNotNull()).select(*own, F.col(column).cast("double").alias("_v")))
    groups = kept(v.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in quantiles]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    # A range: values from _lo to _hi, how many lie below it, how many rows it has, and the ranks wanted in it.
    ranges = groups.select(*names, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_rows"), F.array_sort(ranks).alias("_ranks"))
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]

    def rows_of(r: DataFrame) -> DataFrame:
        on = (F.col("v._v") >= F.col("r._lo")) & (F.col("v._v") <= F.col("r._hi"))
        for c in same("v", "r"):
            on = on & c
        return v.alias("v").join(small_side(r.alias("r")), on)

    while True:
        small = (F.col("_rows") <= limit) | (F.col("_lo") == F.col("_hi"))
        if not ranges.where(~small).limit(1).count():
            break
        cut = rows_of(ranges.where(~small)).withColumn("_p", _part(F.col("_v"), F.col("_lo"), F.col("_hi")))
        parts = cut.groupBy(*[F.col(f"r.{n}").alias(n) for n in names], "_below", "_ranks", "_p").agg(F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*names, "_below").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        parts = parts.withColumn("_ranks", F.filter("_ranks", lambda x: (x >= F.col("_from")) & (x < F.col("_from") + F.col("_rows")))).where(F.size("_ranks") > 0)
        ranges = kept(ranges.where(small).unionByName(parts.select(*names, "_lo", "_hi", F.col("_from").alias("_below"), "_rows", "_ranks")))
    one = F.col("_lo") == F.col("_hi")
    rank = F.explode("_ranks").alias("_rank")
    plain = ranges.where(one).select(*names, rank, F.col("_lo").alias("_value"))
    few = rows_of(ranges.where(~one)).groupBy(*[F.col(f"r.{n}").alias(n) for n in names], "_below", "_ranks").agg(F.array_sort(F.collect_list("_v")).alias("_all"))  # `limit` at most
    few = few.select(*names, "_below", "_all", rank).select(*names, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value"))
    found = plain.unionByName(few).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    on = F.lit(True)
    for c in same("g", "f"):
        on = on & c
    g = groups.alias("g").join(small_side(found.alias("f")), on)
    value = lambda a: F.col("_at")[F.floor(a)] * (1 - (a - F.floor(a))) + F.col("_at")[F.ceil(a)] * (a - F.floor(a))
    return g.select(*[F.col(f"g.{n}").alias(k) for n, k in zip(names, keys, strict=False)], F.col("_n").alias("n"), F.array(*[value(a) for a in at]).alias("q"))
