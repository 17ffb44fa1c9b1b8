"""Places of rows within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(d: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str, counted: Column | None = None) -> DataFrame:
    """Adds the number of rows of the key before each row, or of those for which `counted` holds.

    A key is cut into buckets, whose order must be that of `order`: rows are numbered within a bucket, and what the
    buckets before hold comes from a window over one row a bucket. `order` should leave no ties."""
    one = F.lit(1) if counted is None else F.coalesce(counted, F.lit(False)).cast("int")
    d0 = d.withColumns({"_bucket": bucket, "_one": one.cast("long")})
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = d0.groupBy(*keys, "_bucket").agg(F.sum("_one").alias("_all"))
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d0 = d0.withColumn("_here", F.coalesce(F.sum("_one").over(within), F.lit(0)))
    return d0.join(starts, same).select(*d.columns, (F.col("_start") + F.col("_here")).cast("long").alias(out))


def days(at: str, width: int) -> Column:
    """Number of the stretch of `width` days that a time lies in; a bucket for `ordinal`."""
    return F.floor(F.datediff(F.col(at), F.lit("1970-01-01")) / width)


def stretches(d: DataFrame, place: str, rows: int, reach: int) -> DataFrame:
    """Cuts keys into stretches of `rows` rows by their `place` in the key: adds _stretch and _carried.

    The last `reach` rows of a stretch come once more in the next one, as carried, so that windows of (key, _stretch) that look
    back at most `reach` rows see what those of the key would; carried rows are dropped after them."""
    if reach > rows:
        raise ValueError("a stretch must hold what the next one looks back to")
    own = F.floor(F.col(place) / rows)
    part = lambda k, carried: F.struct(k.alias("_stretch"), F.lit(carried).alias("_carried"))
    parts = F.when(F.col(place) % rows >= rows - reach, F.array(part(own, False), part(own + 1, True))).otherwise(F.array(part(own, False)))
    return d.select("*", F.inline(parts))
