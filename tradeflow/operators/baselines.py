"""Baselines that end before the trades they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period(at: str | Column, days: int) -> Column:
    """Number of the period of `days` that a time lies in."""
    return F.floor(F.datediff(F.col(at) if isinstance(at, str) else at, F.lit("1970-01-01")) / days).cast("int")


def before(t: DataFrame, keys: list[str], at: str = "traded_at", value: str = "notional", days: int = 28, periods: int = 13) -> DataFrame:
    """Per key and period in which it trades: n, total, p50, p95, p99 and oldest of the `periods` periods before it.

    Neither a trade itself nor a later one is in its baseline, and trades older than the window are not.
    The values of a period are gathered once and the periods of a key are looked through by a window over a row each, so no row is
    repeated on its way, and one row holds the values of one key's window, not of its life. Rows are sent once, by key, for both."""
    d = t.select(*keys, period(at, days).alias("period"), F.col(at).alias(at), F.col(value).alias(value)).repartition(*keys)
    v = F.when(F.col(value) > 0, F.col(value))
    d = d.groupBy(*keys, "period").agg(F.collect_list(v).alias("_v"), F.sum(v).alias("total"), F.min(F.when(v.isNotNull(), F.col(at))).alias("oldest"))
    w = Window.partitionBy(*keys).orderBy("period").rangeBetween(-periods, -1)
    d = d.select(*keys, "period", F.array_sort(F.flatten(F.collect_list("_v").over(w))).alias("_all"), F.sum("total").over(w).alias("total"), F.min("oldest").over(w).alias("oldest")).where(F.size("_all") > 0)
    return d.select(*keys, "period", F.size("_all").cast("long").alias("n"), "total", *[_quantile("_all", q).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)], "oldest")


def _quantile(values: str, q: float) -> Column:
    """Of a sorted array, interpolated as by Spark's percentile; null of an empty one."""
    place = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
    return F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def beside(t: DataFrame, keys: list[str], prefix: str, value: str = "notional", periods: int = 13, asks: Column | None = None, opened: dict[str, Column] | None = None) -> DataFrame:
    """t, which has the period of each row, with <prefix>_count, _total and _p95 of the key's rows in the `periods` periods before it.

    Null where there were none, where a key or the period is null, and where `asks` does not hold. What `before` and a join give,
    but each row is sent once, by key: it travels with its period and comes out beside what the window over periods finds.
    `opened` are columns worked out of t's where rows arrive, so that they are not sent: period and value may be among them, and
    they do not come out (`asks` may use t's columns and what is found)."""
    opened = opened or {}
    others = [c for c in t.columns if c not in (*keys, "period")]
    d = t.repartition(*keys).withColumns(opened).groupBy(*keys, "period").agg(F.collect_list(F.struct(*others)).alias("_rows"), F.collect_list(F.when(F.col(value) > 0, F.col(value))).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("period").rangeBetween(-periods, -1)
    d = d.withColumn("_all", F.array_sort(F.flatten(F.collect_list("_v").over(w))))
    known = F.size("_all") > 0
    for k in (*keys, "period"):
        known = known & F.col(k).isNotNull()
    total = F.aggregate("_all", F.lit(0.0), lambda s, v: s + v)
    found = {f"{prefix}_count": F.size("_all").cast("long"), f"{prefix}_total": total, f"{prefix}_p95": _quantile("_all", 0.95)}
    d = d.select(*keys, "period", "_rows", *[F.when(known, c).alias(n) for n, c in found.items()])
    d = d.select(*[k for k in (*keys, "period") if k not in opened], *found, F.inline("_rows"))
    return d if asks is None else d.withColumns({n: F.when(asks, F.col(n)) for n in found})


def with_baselines(t: DataFrame, market: list[str], trader: list[str], days: int = 28, periods: int = 13, rows: DataFrame | None = None) -> DataFrame:
    """rows (some of t's; by default all) with m_count, m_total, m_p95, m_p99, t_count, t_p95 and t_p99 of t's trades before each
    row's period; null where there were none."""
    m = before(t, market, days=days, periods=periods).select(*market, "period", F.col("n").alias("m_count"), F.col("total").alias("m_total"), F.col("p95").alias("m_p95"), F.col("p99").alias("m_p99"))
    w = before(t, trader, days=days, periods=periods).select(*trader, "period", F.col("n").alias("t_count"), F.col("p95").alias("t_p95"), F.col("p99").alias("t_p99"))
    d = (t if rows is None else rows).withColumn("period", period("traded_at", days))
    return d.join(m, [*market, "period"], "left").join(w, [*trader, "period"], "left").drop("period")
