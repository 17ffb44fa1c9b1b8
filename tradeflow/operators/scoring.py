"""Tier scorer, gates and category fan-out as row expressions over joined baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.functions.bands import severity_rank


@dataclass(frozen=True)
class Tier:
    notional: float
    odds: float = 0.0
    profit: float = 0.0
    market_p95: float = 0.0
    market_p99: float = 0.0
    trader_p95: float = 0.0
    trader_p99: float = 0.0


@dataclass(frozen=True)
class Thresholds:
    info: Tier
    warning: Tier
    critical: Tier
    min_trades: int = 20
    min_total: float = 1_000.0
    cap: str | None = "info"  # None: no low-baseline cap
    critical_absolute: bool = True

    @classmethod
    def default(cls) -> Thresholds:
        return cls(Tier(10_000, 3, 5_000, 1.0, 0, 1.0), Tier(25_000, 5, 15_000, 2.0, 0, 1.5), Tier(100_000, 8, 50_000, 4.0, 0, 2.0))

    @classmethod
    def for_driver(cls) -> Thresholds:
        """Tail ratios under which every tier occurs on the driver's prices."""
        return cls(Tier(10_000, 3, 5_000, 0.5, 0, 0.3), Tier(25_000, 5, 15_000, 0.8, 0, 0.5), Tier(100_000, 8, 50_000, 1.0, 0, 0.8))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _failure(t: Tier) -> Column:
    """The first gate of a tier that a row fails; null if it passes all. Ratios hold only where ready."""
    out = F.when((F.col("notional") < t.notional) | ((F.col("odds") < t.odds) if t.odds > 0 else F.lit(False)), "below_absolute")
    if t.profit > 0:
        out = out.when(F.col("profit") < t.profit, "below_payoff")
    for ready, ratio, least, name in (("m_ready", "m_p95_ratio", t.market_p95, "below_market_p95"), ("m_ready", "m_p99_ratio", t.market_p99, "below_market_p99"),
                                      ("t_ready", "t_p95_ratio", t.trader_p95, "below_trader_p95"), ("t_ready", "t_p99_ratio", t.trader_p99, "below_trader_p99")):
        if least > 0:
            out = out.when(F.col(ready) & (F.col(ratio) < least), name)
    return out


def may_fire(t: Thresholds, notional: Column | None = None, price: Column | None = None) -> Column:
    """Whether a trade meets the least of what the tiers ask of it alone: others get no severity, whatever their baselines."""
    notional = F.col("notional") if notional is None else notional
    price = F.col("price") if price is None else price
    odds = F.try_divide(F.lit(1.0), price)
    least = {c: min(getattr(x, c) for x in (t.info, t.warning, t.critical)) for c in ("notional", "odds", "profit")}
    sound = (notional > 0) & (price > 0) & (price < 1)
    return F.coalesce(sound & (notional >= least["notional"]) & (odds >= least["odds"]) & (notional * (odds - 1) >= least["profit"]), F.lit(False))


def score(d: DataFrame, t: Thresholds) -> DataFrame:
    """Adds odds, payout, profit, ratios, m_ready, t_ready, severity (null: not fired), capped, reason.

    d has notional, price and m_count, m_total, m_p95, m_p99, t_count, t_p95, t_p99; baselines
    that are missing (null) count as not ready."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    d = d.withColumns({c: zero(c) for c in ("m_count", "m_total", "m_p95", "m_p99", "t_count", "t_p95", "t_p99")})
    d = d.withColumns({"odds": F.try_divide(F.lit(1.0), F.col("price"))})
    d = d.withColumns({
        "payout": F.col("notional") * F.col("odds"), "profit": F.col("notional") * (F.col("odds") - 1),
        "m_p95_ratio": _ratio("notional", "m_p95"), "m_p99_ratio": _ratio("notional", "m_p99"), "t_p95_ratio": _ratio("notional", "t_p95"), "t_p99_ratio": _ratio("notional", "t_p99"),
        "m_ready": (F.col("m_count") >= t.min_trades) & (F.col("m_total") >= t.min_total) & (F.col("m_p95") > 0),
        "t_ready": (F.col("t_count") >= t.min_trades) & (F.col("t_p95") > 0)})
    valid = F.coalesce((F.col("notional") > 0) & (F.col("price") > 0) & (F.col("price") < 1), F.lit(False))
    raw = F.when(~valid, F.lit(None).cast("string")).when(_failure(t.critical).isNull(), "critical").when(_failure(t.warning).isNull(), "warning").when(_failure(t.info).isNull(), "info")
    d = d.withColumn("raw_severity", raw)
    if t.cap is None:
        capped = F.lit(False)
    else:
        excused = (F.col("notional") >= t.critical.notional) & (F.col("odds") >= t.critical.odds) if t.critical_absolute else F.lit(False)
        capped = ~F.col("m_ready") & ~excused & (severity_rank("raw_severity") > severity_rank(F.lit(t.cap)))
    d = d.withColumn("capped", F.coalesce(capped, F.lit(False)))
    return d.withColumns({"severity": F.when(F.col("capped"), F.lit(t.cap)).otherwise(F.col("raw_severity")),
                          "reason": F.when(~valid, "invalid_input").when(F.col("raw_severity").isNull(), _failure(t.info))})


def gated(d: DataFrame, now: str, alert_from: float = 75, hot_from: float = 90, min_age_hours: float = 24, max_lag: str = "1 hour") -> DataFrame:
    """Adds alertable, hot and too_late; an unknown life-cycle fails closed."""
    pct = F.col("lifecycle")
    age = F.timestamp_diff("SECOND", F.col("start_at"), F.col("traded_at")) / 3600
    return d.withColumns({"alertable": F.coalesce((pct >= alert_from) & (age >= min_age_hours), F.lit(False)), "hot": F.coalesce(pct >= hot_from, F.lit(False)),
                          "too_late": F.col("traded_at") < F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {max_lag}")})


def allowed_category(label: Column, slug: Column, allow: list[str]) -> Column:
    """Case-folded substring of slug or label; an empty list allows all, an empty label is denied by any list."""
    if not allow:
        return F.lit(True)
    out = F.lit(False)
    for a in allow:
        out = out | F.lower(F.coalesce(slug, F.lit(""))).contains(a.lower()) | F.lower(F.coalesce(label, F.lit(""))).contains(a.lower())
    return out & (F.coalesce(label, F.lit("")) != "")


def strongest_category(d: DataFrame, keys: list[str], categories: str = "categories") -> DataFrame:
    """d has an array of (category, position, severity) per trade: the one of highest severity, the later on ties."""
    best = F.array_max(F.transform(categories, lambda c: F.struct(severity_rank(c["severity"]).alias("rank"), c["position"].alias("position"), c["category"].alias("category"), c["severity"].alias("severity"))))
    return d.select(*keys, best["category"].alias("category"), best["severity"].alias("severity"))
