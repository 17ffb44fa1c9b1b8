"""Distributions, lines and flow of trades, each as one pass over all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(t: DataFrame, keys: list[str], value: str = "notional", at: str = "traded_at", since: str | None = None) -> DataFrame:
    """n, total, mean, median, p95, p99 (interpolated) and first and last time of every key."""
    if since is not None:
        t = t.where(F.col(at) >= F.to_timestamp_ntz(F.lit(since)))
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    d = t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), q.alias("_q"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    return d.select(*keys, "n", "total", "mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p99"), "oldest", "newest")


def distribution_of(keys: DataFrame, dist: DataFrame, on: list[str]) -> DataFrame:
    """The asked keys with their distribution; zeros and null times for keys without trades."""
    d = keys.join(dist, on, "left")
    return d.fillna(0, subset=[c for c in ("n", "total", "mean", "median", "p95", "p99") if c in d.columns])


def span(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("notional").alias("total"), F.min("traded_at").alias("oldest"), F.max("traded_at").alias("newest"))


def newest(t: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key in an order that ends in a unique column."""
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest(t: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return newest(t, keys, 1, order).drop("rank")


def price_window(t: DataFrame, keys: list[str]) -> DataFrame:
    """Price statistics of a window; first and last price by time, ties by order and line number."""
    at = F.struct("traded_at", "order_id", "line_no", "price")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("notional")).otherwise(0))
    return t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("price").alias("mean"), F.stddev_pop("price").alias("stddev"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"), F.sum("notional").alias("volume"), side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"))


def side_activity(t: DataFrame, keys: list[str]) -> DataFrame:
    buy = F.col("side") == "BUY"
    return t.groupBy(*keys).agg(
        F.count_if(buy).alias("buy_n"), F.count_if(~buy).alias("sell_n"),
        F.sum(F.when(buy, F.col("notional")).otherwise(0.0)).alias("buy_usd"), F.sum(F.when(~buy, F.col("notional")).otherwise(0.0)).alias("sell_usd"))


def market_maker(activity: DataFrame, per_side: int = 4, tolerance: float = 0.3) -> DataFrame:
    """Adds imbalance and suppress: enough trades on both sides and balanced."""
    hi = F.greatest("buy_usd", "sell_usd")
    d = activity.withColumn("imbalance", F.when(hi > 0, F.abs(F.col("buy_usd") - F.col("sell_usd")) / hi).otherwise(0.0))
    return d.withColumn("suppress", (F.col("buy_n") >= per_side) & (F.col("sell_n") >= per_side) & (F.col("imbalance") <= tolerance))


def ownership(t: DataFrame, market_keys: list[str], wallet: str = "trader_id") -> DataFrame:
    """Wallet's net shares against all bought shares of the outcome, in percent, with a tier."""
    buy = F.col("side") == "BUY"
    mine = t.groupBy(*market_keys, wallet).agg(F.sum(F.when(buy, F.col("shares")).otherwise(0.0)).alias("wallet_buy"), F.sum(F.when(~buy, F.col("shares")).otherwise(0.0)).alias("wallet_sell"), F.avg("price").alias("price"))
    # The whole is a second grain of the same sums, so trades are scanned once more narrow, not joined per row.
    whole = t.groupBy(*market_keys).agg(F.sum(F.when(buy, F.col("shares")).otherwise(0.0)).alias("market_buy"))
    return mine.join(whole, market_keys)


def ownership_verdict(d: DataFrame, least: float = 10_000, tiers: tuple[float, float, float] = (10, 15, 25)) -> DataFrame:
    net = F.greatest(F.col("wallet_buy") - F.col("wallet_sell"), F.lit(0.0))
    d = d.withColumns({"net": net, "share_pct": F.when(F.col("market_buy") > 0, 100 * net / F.col("market_buy")).otherwise(0.0), "usd": net * F.col("price")})
    sev = F.when(F.col("usd") < least, F.lit(None).cast("string")).when(F.col("share_pct") >= tiers[2], "critical").when(F.col("share_pct") >= tiers[1], "warning").when(F.col("share_pct") >= tiers[0], "info")
    return d.withColumn("severity", sev)


def lines(t: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulation lines: what one wallet did on one side of one outcome."""
    odds = F.try_divide(F.lit(1.0), F.col("price"))
    return t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("notional").alias("total"), F.avg("notional").alias("mean"), F.percentile("notional", F.lit(0.5)).alias("median"), F.max("notional").alias("largest"), F.min("notional").alias("least"),
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.avg(odds).alias("avg_odds"), F.max(odds).alias("max_odds"), F.min("traded_at").alias("oldest"), F.max("traded_at").alias("newest"))


def previous(t: DataFrame, keys: list[str], at: str = "traded_at", out: str = "previous_at") -> DataFrame:
    """Last time strictly before the row's, per key: equal times do not count as earlier.

    Distinct times are lagged, which is one row per key and time however many rows tie."""
    times = t.select(*keys, at).distinct().withColumn(out, F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))
    return t.join(times, [*keys, at])


def quiet_wakeup(d: DataFrame, per_day: float = 10, usd_per_day: float = 5_000, idle_hours: float = 6, least: float = 10_000, multiple: float = 50) -> DataFrame:
    """Adds wakes: a large trade on a market with little history. d: n, total, span_h, median, last_at, at, notional."""
    days = F.col("span_h") / 24
    idle = F.greatest(F.timestamp_diff("SECOND", F.col("last_at"), F.col("at")), F.lit(0)) / 3600
    ok = (F.col("n") >= 1) & (F.col("span_h") > 0) & (F.col("notional") >= least) & (F.try_divide(F.col("n"), days) <= per_day) & (F.try_divide(F.col("total"), days) <= usd_per_day)
    ok = ok & (F.col("last_at").isNull() | (idle >= idle_hours)) & ((F.col("median") <= 0) | (F.try_divide(F.col("notional"), F.col("median")) >= multiple))
    return d.withColumn("wakes", F.coalesce(ok, F.lit(False)))


def wallet_age(t: DataFrame, new_hours: float = 168, few: int = 10, dormant_hours: float = 720, least: float = 5_000) -> DataFrame:
    """Adds is_new (young or short history) and dormant (long idle, not new, not small) per trade of (trader_id).

    A wallet's trades are sent and sorted once; the time before a trade's own is the last that differed on the way to it."""
    w = Window.partitionBy("trader_id")
    run = w.orderBy("traded_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lag("traded_at").over(w.orderBy("traded_at"))
    d = t.withColumns({"first_seen": F.min("traded_at").over(run), "_last": F.when(last < F.col("traded_at"), last), "history": F.count("*").over(w)})
    d = d.withColumn("wallet_previous_at", F.last("_last", ignorenulls=True).over(run)).drop("_last")
    hours = lambda a, b: F.timestamp_diff("SECOND", a, b) / 3600
    new = (hours(F.col("first_seen"), F.col("traded_at")) <= new_hours) | (F.col("history") <= few)
    idle = F.coalesce(hours(F.col("wallet_previous_at"), F.col("traded_at")) >= dormant_hours, F.lit(False))
    return d.withColumns({"is_new": new, "dormant": ~new & idle & (F.col("notional") >= least)})


def event_flow(t: DataFrame) -> DataFrame:
    """Per event: strongest (market, outcome, side), buy and sell sums, imbalance, largest trade."""
    by = t.groupBy("event_id", "market_id", "outcome", "side").agg(F.sum("notional").alias("usd"), F.count("*").alias("k"), F.max("notional").alias("largest"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("usd")).otherwise(0.0))
    e = by.groupBy("event_id").agg(side("BUY").alias("buy_usd"), side("SELL").alias("sell_usd"), F.sum("k").alias("n"), F.max("largest").alias("largest_trade"),
                                   F.max_by(F.struct("market_id", "outcome", "side", "usd"), F.struct("usd", "market_id", "outcome", "side")).alias("_top"))
    total = F.col("buy_usd") + F.col("sell_usd")
    return e.select("event_id", "n", "buy_usd", "sell_usd", F.coalesce(F.try_divide(F.col("buy_usd") - F.col("sell_usd"), total), F.lit(0.0)).alias("imbalance"), "largest_trade",
                    F.col("_top.market_id").alias("top_market"), F.col("_top.outcome").alias("top_outcome"), F.col("_top.side").alias("top_side"), F.col("_top.usd").alias("top_usd"))
