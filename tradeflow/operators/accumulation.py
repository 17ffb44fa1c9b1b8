"""Verdict on accumulation lines: size path, tier, hard escalation, score, confidence and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.operators.scoring import Thresholds, Tier

_SCORE = {"critical": 60, "warning": 40, "info": 20}


def _over(a: str, b: str) -> Column:
    return F.try_divide(F.col(a), F.when(F.col(b) > 0, F.col(b)))


def verdict(d: DataFrame, t: Thresholds, trade_floors: tuple[int, int, int] = (3, 4, 5), total_x: float = 2, smalls_x: float = 4, median_share: float = 0.6, hard_x: float = 3) -> DataFrame:
    """Adds severity (null: not fired), size_path, score 0-100, confidence 0-1 and reasons.

    d: n, total, median, largest, avg_odds, oldest, newest, market_p95, trader_p95 (0 or null: not
    ready), lifecycle, hot. trade_floors are the least trades of info, warning and critical."""
    d = d.withColumns({"market_p95": F.coalesce("market_p95", F.lit(0.0)), "trader_p95": F.coalesce("trader_p95", F.lit(0.0)), "lifecycle": F.coalesce("lifecycle", F.lit(0.0))})
    profit = F.when((F.col("avg_odds") > 1) & (F.col("total") > 0), F.col("total") * (F.col("avg_odds") - 1)).otherwise(0.0)
    d = d.withColumns({"line_profit": profit, "_lm": F.coalesce(_over("total", "market_p95"), F.lit(0.0)), "_mm": F.coalesce(_over("largest", "market_p95"), F.lit(0.0)), "_lt": F.coalesce(_over("total", "trader_p95"), F.lit(0.0))})

    def path(x: Tier) -> Column:
        if x.notional <= 0:
            return F.when(F.col("total") > 0, "many-smalls")
        return F.when(F.col("total") >= smalls_x * x.notional, "many-smalls").when((F.col("total") >= total_x * x.notional) & (F.col("median") >= median_share * x.notional), "meaningful")

    def passes(x: Tier, least: int) -> Column:
        c = (F.col("n") >= least) & path(x).isNotNull()
        if x.odds > 0:
            c = c & (F.col("avg_odds") >= x.odds)
        if x.profit > 0:
            c = c & (F.col("line_profit") >= x.profit)
        if x.market_p95 > 0:
            c = c & ((F.col("market_p95") <= 0) | (F.greatest("_lm", "_mm") >= x.market_p95))
        if x.trader_p95 > 0:
            c = c & ((F.col("trader_p95") <= 0) | (F.col("_lt") >= x.trader_p95))
        return c

    tiers = [("critical", t.critical, trade_floors[2]), ("warning", t.warning, trade_floors[1]), ("info", t.info, trade_floors[0])]
    tier = F.lit(None).cast("string")
    for name, x, least in reversed(tiers):
        tier = F.when(passes(x, least), name).otherwise(tier)
    d = d.withColumn("tier", F.when(F.col("n") >= trade_floors[0], tier))
    of = lambda f: F.coalesce(*[F.when(F.col("tier") == name, f(x, name)) for name, x, _ in tiers])
    hard = (F.col("tier") == "critical") & F.coalesce(F.col("hot"), F.lit(False)) & (F.col("total") >= hard_x * t.critical.notional)
    part = lambda ratio: F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio / 4))

    def points(x: Tier, name: str) -> Column:
        s = F.lit(float(_SCORE[name]))
        if x.notional > 0:
            s = s + part(F.col("total") / (total_x * x.notional)) * 20
        if x.market_p95 > 0:
            s = s + part(F.col("_lm") / x.market_p95) * 10
        if x.trader_p95 > 0:
            s = s + part(F.col("_lt") / x.trader_p95) * 5
        return s + F.least(F.col("lifecycle") / 20, F.lit(5.0))

    def why(x: Tier, name: str) -> Column:
        low = (F.col("market_p95") <= 0) | (F.col("trader_p95") <= 0)
        return F.array_compact(F.array(
            F.lit("SAME_TRADER_ACCUMULATION"),
            F.when((x.profit > 0) & (F.col("line_profit") >= 2 * x.profit), "LINE_PAYOFF_HIGH"),
            F.when(path(x) == "many-smalls", "MANY_SMALLS_SAME_SIDE"),
            F.when((x.market_p95 > 0) & (F.greatest("_lm", "_mm") >= 2 * x.market_p95) & (F.col("market_p95") > 0), "LINE_MARKET_TAIL"),
            F.when((x.trader_p95 > 0) & (F.col("_lt") >= 2 * x.trader_p95) & (F.col("trader_p95") > 0), "LINE_TRADER_TAIL"),
            F.when(low, "LOW_BASELINE_CONFIDENCE"), F.when(F.col("lifecycle") >= 75, "LATE_MARKET_ACCUMULATION"),
            F.when(F.coalesce(F.col("hot"), F.lit(False)), "HOT_MARKET_ACCUMULATION"), F.when(F.col("n") < trade_floors[0] + 2, "LOW_SAMPLE_SIZE")))

    hours = F.when(F.col("n") >= 2, F.timestamp_diff("SECOND", F.col("oldest"), F.col("newest")) / 3600).otherwise(0.0)
    conf = F.when((F.col("market_p95") > 0) & (F.col("trader_p95") > 0), 0.4).when(F.col("market_p95") > 0, 0.3).otherwise(0.2)
    conf = conf + 0.3 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.3 * F.least(hours / 4, F.lit(1.0))
    d = d.withColumns({"severity": F.when(hard, "hard").otherwise(F.col("tier")), "size_path": of(lambda x, _: path(x)), "score": F.round(F.least(F.lit(100.0), of(points))).cast("int"),
                       "confidence": F.when(F.col("tier").isNotNull(), F.least(F.lit(1.0), conf)), "reasons": of(why)})
    return d.drop("_lm", "_mm", "_lt", "tier")
