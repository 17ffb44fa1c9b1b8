"""Forward returns, outcome classification, calibration and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.functions.bands import calibration_band, severity_weight
from tradeflow.operators.asof import asof
from tradeflow.operators.selection import percentiles
from tradeflow.sources.scratch import kept


def forward_returns(alerts: DataFrame, prices: DataFrame, by: list[str], at: str, price_at: str, horizons: dict[str, int], unique: bool = False) -> DataFrame:
    """Per horizon (days) the signed relative return ret_* and the signed move in cents clv_*, from the
    first price at or after at + horizon; null where there is none yet. unique: there is one price a key and time."""
    sign = F.when(F.col("side") == "SELL", -1).otherwise(1)
    p = prices.select(*by, F.col(price_at).alias("_pa"), F.col("price").alias("_later"))
    # One as-of join for all horizons, of places and times alone: a row for each and horizon, folded back on the two. The alerts, which
    # are wider and more, meet what was found once.
    due = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(at) + F.expr(f"INTERVAL {days} DAYS")).alias("due")) for i, days in enumerate(horizons.values())]))
    e = alerts.select(*by, at).distinct().select(*by, at, due.alias("_x")).select(*by, at, F.col("_x.i").alias("_i"), F.col("_x.due").alias("_due"))
    e = asof(e, p, by, "_due", "_pa", ["_later"], "forward", unique=unique)
    names = [f"_k{i}" for i in range(len(by) + 1)]
    folded = e.groupBy(*[F.col(c).alias(n) for c, n in zip([*by, at], names, strict=True)]).agg(*[F.max(F.when(F.col("_i") == i, F.col("_later"))).alias(f"_l{i}") for i in range(len(horizons))])
    same = F.lit(True)
    for c, n in zip([*by, at], names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    d = alerts.join(folded, same, "left")
    out = []
    for i, name in enumerate(horizons):
        move = F.col(f"_l{i}") - F.col("price")
        out += [(sign * move / F.col("price")).alias(name), (move * 100 * sign).alias(name.replace("ret", "clv"))]
    return d.select(*alerts.columns, *out)


def drift_status(columns: list[str]) -> Column:
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(known == len(columns), "done").when(known > 0, "partial").otherwise("pending")


def reversal(clv_15m: str = "clv_15m", clv_1h: str = "clv_1h") -> Column:
    return (F.col(clv_15m) > 0) & (F.col(clv_1h) <= 0)


def winner(outcomes: str, prices: str, least: float = 0.99) -> Column:
    """The first outcome priced at `least` or more; null if unresolved."""
    hit = F.filter(F.arrays_zip(F.col(outcomes).alias("o"), F.col(prices).alias("p")), lambda x: x["p"].cast("double") >= least)
    return F.get(hit, F.lit(0))["o"]


def classified(won: Column, label: Column, side: Column) -> Column:
    """correct, wrong or unknown; a SELL is right when its label does not win."""
    return F.when(won.isNull() | label.isNull(), "unknown").when((F.lower(won) == F.lower(label)) == (side == "BUY"), "correct").otherwise("wrong")


def with_edge(d: DataFrame) -> DataFrame:
    """Adds implied probability, realised edge (null while unresolved), calibration band and weight."""
    p = F.when(F.col("side") == "SELL", 1 - F.col("price")).otherwise(F.col("price"))
    return d.withColumns({"implied": p}).withColumns({
        "edge": F.when(F.col("outcome_status") == "correct", 1 - F.col("implied")).when(F.col("outcome_status") == "wrong", -F.col("implied")),
        "bucket": calibration_band("implied"), "weight": severity_weight("severity")})


def promotion_samples(d: DataFrame, extra: dict[str, Column] | None = None, return_col: str = "clv_6h") -> DataFrame:
    """n, median, reversal ratio and rows a day at three grains at once, as grouping sets:
    (strategy, version), with decision level, and with linkage."""
    extra = extra or {"level": F.col("level"), "linkage": F.when(F.col("linked_key").isNotNull(), "linked").otherwise("standalone")}
    d = d.withColumns(extra).withColumn("_rev", reversal().cast("double"))
    days = F.greatest(F.datediff(F.max("created_at"), F.min("created_at")), F.lit(1))
    sets = [[F.col("strategy"), F.col("version")], *[[F.col("strategy"), F.col("version"), F.col(c)] for c in extra]]
    d = kept(d.select("strategy", "version", *extra, "created_at", return_col, "_rev"))
    plain = d.groupingSets(sets, "strategy", "version", *extra).agg(F.grouping_id().alias("grain"), F.avg("_rev").alias("reversal"), (F.count("*") / days).alias("per_day"))
    # The medians of few, huge groups: a row for each grain, its columns null where the grain leaves them out.
    grain = lambda on: F.struct(*[(F.col(c) if c in on else F.lit(None).cast("string")).alias(c) for c in extra], F.lit(sum(1 << k for k, c in enumerate(reversed(list(extra))) if c not in on)).cast("long").alias("grain"))
    each = d.select("strategy", "version", return_col, F.explode(F.array(grain([]), *[grain([c]) for c in extra])).alias("_g")).select("strategy", "version", return_col, "_g.*")
    keys = ["strategy", "version", *extra, "grain"]
    medians = percentiles(each, keys, return_col, (0.5,)).select(*[F.col(k).alias(f"_{k}") for k in keys], "n", F.col("q")[0].alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return plain.join(medians, same, "left").select("strategy", "version", *extra, "grain", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "median", "reversal", "per_day")


def eligible(min_n: int = 30, min_median: float = 0.0, max_reversal: float = 0.4, max_per_day: float = 50.0) -> Column:
    return F.coalesce((F.col("n") >= min_n) & (F.col("median") > min_median) & (F.col("reversal") <= max_reversal) & (F.col("per_day") <= max_per_day), F.lit(False))
