"""As-of join by union, sort and a running window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", strict: bool = False, bucket_days: int = 365, unique: bool = False) -> DataFrame:
    """left with `values` of the right row nearest in time on one side; null where there is none.

    backward: the latest right row at or before left_ts (strict: before); forward: the earliest
    at or after it. Of right rows at one time the largest by `values` counts. A key of any size
    is cut into buckets of time; what earlier (later) buckets hold last (first) is carried over
    by a window over one row per bucket. unique: right has one row a key and time, which need not be looked for.
    """
    back = direction == "backward"
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days).cast("int")
    names = [f"_v{i}" for i in range(len(values))]
    pack = F.struct(*names)
    r = right.select(*by, F.col(right_ts).alias("_t"), *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    # One value is sought as it is, as structs have no place in a hash table of aggregates.
    if not unique:
        r = r.groupBy(*by, "_t").agg(F.max(pack).alias("_s")).select(*by, "_t", "_s.*") if len(names) > 1 else r.groupBy(*by, "_t").agg(F.max(names[0]).alias(names[0]))
    r = r.withColumn("_b", bucket(F.col("_t")))
    end = F.max_by if back else F.min_by
    ends = r.groupBy(*by, "_b").agg(end(pack if len(names) > 1 else F.col(names[0]), "_t").alias("_e"))
    ends = ends if len(names) > 1 else ends.select(*by, "_b", F.struct(F.col("_e").alias(names[0])).alias("_e"))
    r = r.select(*by, "_t", "_b", pack.alias("_s"))
    lcols = left.columns
    lhs = left.withColumns({"_t": F.col(left_ts), "_b": bucket(F.col(left_ts)), "_left": F.lit(True)})
    both = lhs.withColumn("_s", F.lit(None).cast(r.schema["_s"].dataType)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    # On ties the right row comes first where it counts, else last; seen from the direction of travel.
    right_first = 0 if not strict else 1
    tie = F.when(F.col("_left"), 1 - right_first).otherwise(right_first)
    order = [F.col("_t").asc() if back else F.col("_t").desc(), tie.asc()]
    near = F.last("_s", ignorenulls=True).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumn("_near", near).where("_left")
    wanted = left.select(*by, bucket(F.col(left_ts)).alias("_b")).distinct()
    marks = wanted.join(ends, [*by, "_b"], "full")
    over = Window.partitionBy(*by).orderBy(F.col("_b").asc() if back else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), F.last("_e", ignorenulls=True).over(over).alias("_carried"))
    cond = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        cond = cond & (F.col(c) == F.col(f"_k{i}"))
    d = d.join(carried, cond, "left").withColumn("_f", F.coalesce("_near", "_carried"))
    return d.select(*lcols, *[F.col(f"_f.{n}").alias(v) for v, n in zip(values, names, strict=True)])
