"""Shadow detectors as row expressions and small joins; score units are cents where named so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.operators.ranks import days, ordinal, stretches

#: Fixed values: (words, weight, reason, kind) of wording that makes a resolution rule ambiguous.
RULE_MARKERS = [
    ("runoff", 0.20, "runoff_dependency", "procedural"), ("recount", 0.20, "recount_dependency", "procedural"),
    ("certification", 0.15, "certification_dependency", "procedural"), ("certified", 0.15, "certification_dependency", "procedural"),
    ("appeal", 0.15, "appeal_dependency", "procedural"), ("court", 0.10, "court_dependency", "procedural"), ("ruling", 0.10, "ruling_dependency", "procedural"),
    ("supreme court", 0.05, "supreme_court_dependency", "procedural"), ("injunction", 0.15, "injunction_dependency", "procedural"), ("impeachment", 0.10, "impeachment_dependency", "procedural"),
    ("definitive", 0.10, "definitive_terminology", "wording"), ("first", 0.05, "first_terminology", "wording"), ("considered", 0.10, "considered_subjective", "wording"),
    ("significant", 0.08, "significant_subjective", "wording"), ("material", 0.05, "material_subjective", "wording"), ("primarily", 0.05, "primarily_qualifier", "wording"), ("largely", 0.05, "largely_qualifier", "wording"),
    ("by end of", 0.10, "vague_deadline", "deadline"), ("end of year", 0.05, "end_of_year_deadline", "deadline"), ("end of month", 0.05, "end_of_month_deadline", "deadline"), ("on or before", 0.05, "soft_deadline", "deadline"),
    ("announced", 0.10, "announcement_dependency", "source"), ("official", 0.10, "official_source_dependency", "source"), ("officially", 0.10, "officially_qualifier", "source"),
    ("reports say", 0.10, "unnamed_reports", "source"), ("sources say", 0.10, "unnamed_sources", "source"), ("according to reports", 0.10, "unnamed_reports", "source"),
]
#: Names whose mention lowers the ambiguity, once.
NAMED_SOURCES = ["associated press", "ap ", "reuters", "bloomberg", "afp", "new york times", "nyt", "wall street journal", "wsj", "washington post"]
#: Fixed values: (word, weight) by regime, in the order of priority in which a later regime wins ties.
REGIMES = {
    "oracle_sensitive": [("uma", 0.40), ("chainlink", 0.35), ("oracle", 0.25), ("attester", 0.25), ("dispute", 0.15), ("clarification", 0.10), ("verifiable", 0.10), ("verified", 0.10)],
    "geopolitics_military": [("war", 0.30), ("ceasefire", 0.40), ("missile", 0.35), ("airstrike", 0.40), ("invasion", 0.40), ("military", 0.20), ("nato", 0.25), ("troops", 0.25), ("hostages", 0.30),
                             ("sanctions", 0.15), ("ukraine", 0.20), ("russia", 0.15), ("israel", 0.15), ("iran", 0.15), ("gaza", 0.20), ("taiwan", 0.20)],
    "politics_governance": [("election", 0.30), ("president", 0.20), ("senate", 0.25), ("congress", 0.20), ("primary", 0.20), ("caucus", 0.25), ("governor", 0.20), ("mayor", 0.15), ("vote", 0.10), ("impeach", 0.30),
                            ("confirmation hearing", 0.20), ("supreme court", 0.20), ("legislation", 0.20), ("bill", 0.10), ("politics", 0.15)],
    "corporate_private_info": [("earnings", 0.30), ("revenue", 0.20), ("acquisition", 0.30), ("merger", 0.30), ("ipo", 0.30), ("ceo", 0.20), ("resign", 0.15), ("layoff", 0.20), ("product launch", 0.25), ("company", 0.10)],
}


def _total(text: Column, markers) -> Column:
    return sum((F.when(text.contains(w), F.lit(x)).otherwise(F.lit(0.0)) for w, x in markers), F.lit(0.0))


def rules_risk(d: DataFrame, texts: list[str], kind: str | None = None, markers=None, sources=None, block_repricing: float = 0.7, block_tail: float = 0.6) -> DataFrame:
    """Adds ambiguity, dispute, procedural and wording hits, reasons and action."""
    markers, sources = markers or RULE_MARKERS, NAMED_SOURCES if sources is None else sources
    d = d.withColumn("_text", F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])))
    t = F.col("_text")
    hits = lambda k: sum((t.contains(w).cast("int") for w, _, _, c in markers if c == k), F.lit(0))
    named = F.lit(False)
    for s in sources:
        named = named | t.contains(s)
    d = d.withColumns({"_base": _total(t, [(w, x) for w, x, _, _ in markers]), "procedural": hits("procedural"), "wording": hits("wording"), "_named": named})
    extra = F.when(F.col("procedural") >= 3, 0.10).when(F.col("procedural") >= 2, 0.05).otherwise(0.0) + F.when(F.col("wording") >= 3, 0.05).otherwise(0.0) - F.when(F.col("_named"), 0.05).otherwise(0.0)
    if kind is not None:
        extra = extra + F.when(F.col(kind).isin("court_ruling", "certification"), 0.10).otherwise(0.0)
    # Sums of hundredths are rounded so that band edges do not depend on the order of addition.
    a = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_base") + extra)), 6)
    d = d.withColumn("ambiguity", a)
    action = F.when((F.col("ambiguity") >= block_repricing) & (F.col("ambiguity") >= block_tail), "block_both").when(F.col("ambiguity") >= block_repricing, "block_repricing_lag").when(F.col("ambiguity") >= block_tail, "block_cheap_tail").otherwise("allow")
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(t.contains(w), r) for w, _, r, _ in markers])))
    return d.withColumns({"dispute": F.when(F.col("ambiguity") >= 0.6, F.col("ambiguity")).otherwise(F.col("ambiguity") * 0.9), "action": action, "reasons": reasons}).drop("_text", "_base", "_named")


def regime(d: DataFrame, texts: list[str], regimes=None, floor: float = 0.20) -> DataFrame:
    """Adds regime and regime_score: the regime of the largest sum of at least `floor`, the later one on ties."""
    regimes = regimes or REGIMES
    d = d.withColumn("_text", F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])))
    sums = F.array(*[F.struct(F.round(_total(F.col("_text"), m), 6).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("r")) for i, (name, m) in enumerate(regimes.items())])
    d = d.withColumn("_best", F.array_max(sums))
    ok = F.col("_best.s") >= floor
    return d.withColumns({"regime": F.when(ok, F.col("_best.r")).otherwise("other"), "regime_score": F.when(ok, F.least(F.lit(1.0), F.col("_best.s"))).otherwise(0.0)}).drop("_text", "_best")


def cheap_tail(t: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.15, least: float = 2_500, min_trades: int = 2, warning: float = 30, critical: float = 60) -> DataFrame:
    """Staged buying of unlikely outcomes: convexity (mean 1/price) times notional in units of the floor."""
    d = t.where(F.col("price").between(low, high) & (F.col("notional") >= least)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(1 / F.col("price")).alias("convexity"), (F.sum("notional") / least).alias("strength"),
        F.min_by("price", F.struct("traded_at", "order_id", "line_no", "price")).alias("first_price"), F.max("lifecycle").alias("lifecycle")).where(F.col("n") >= min_trades)
    d = d.withColumn("score", F.col("convexity") * F.col("strength") * F.when(F.col("lifecycle") > 0, 0.5 + F.col("lifecycle") / 200).otherwise(1.0))
    return d.withColumns({"band": F.when(F.col("first_price") <= 0.05, "deep_tail").otherwise("near_tail"), "level": F.when(F.col("score") >= critical, "critical").when(F.col("score") >= warning, "warning").otherwise("info")})


def conflict(d: DataFrame, mm_penalty: float = 0.4, degrade: float = 1.5, suppress: float = 2.5, boost: float = 6) -> DataFrame:
    """d: score_a, score_b, mm_a, mm_b. Adds winner, dominance, action and boost."""
    q = lambda s, m: F.col(s) * F.when(F.col(m), 1 - mm_penalty).otherwise(1.0)
    d = d.withColumns({"_a": q("score_a", "mm_a"), "_b": q("score_b", "mm_b")})
    d = d.withColumn("dominance", F.greatest("_a", "_b") / F.greatest(F.least("_a", "_b"), F.lit(0.01)))
    none = (F.col("_a") == 0) & (F.col("_b") == 0)
    action = F.when(none, "keep_both").when(F.col("dominance") >= suppress, "boost_winner_suppress_loser").when(F.col("dominance") >= degrade, "boost_winner_degrade_loser").otherwise("tag_unresolved")
    d = d.withColumn("action", action)
    won = F.col("action").startswith("boost")
    return d.withColumns({"winner": F.when(won, F.when(F.col("_a") >= F.col("_b"), "A").otherwise("B")),
                          "boost": F.when(F.col("action").endswith("suppress_loser"), float(boost)).when(won, boost * (F.col("dominance") - 1) / (suppress - 1)).otherwise(0.0)}).drop("_a", "_b")


def holder_rank(h: DataFrame, keys: list[str], shares: str = "shares", holder: str = "trader_id") -> DataFrame:
    """Adds rank by shares, total open interest and the holder's part of it."""
    w = Window.partitionBy(*keys)
    total = h.groupBy(*keys).agg(F.sum(shares).alias("total_oi"))
    return h.withColumn("rank", F.row_number().over(w.orderBy(F.desc(shares), holder))).join(total, keys).withColumn("pct_oi", F.coalesce(F.try_divide(F.col(shares), F.col("total_oi")), F.lit(0.0)))


def holder_delta(d: DataFrame, tiers: tuple[float, float, float] = (0.03, 0.08, 0.15), top: int = 5, least: float = 1.0, shrink: float = 0.5) -> DataFrame:
    """d: rank, prev_rank, shares, prev_shares, pct_oi, total_oi, prev_total_oi (previous null: none). Adds level, score, penalty."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    d = d.withColumns({"delta_shares": F.col("shares") - z("prev_shares"), "delta_rank": F.when(z("prev_rank") > 0, z("prev_rank") - F.col("rank")).otherwise(0.0),
                       "oi_delta": F.when(z("prev_total_oi") > 0, (F.col("total_oi") - z("prev_total_oi")) / z("prev_total_oi")).otherwise(0.0)})
    artefact = (F.col("oi_delta") < -0.05) & (F.col("delta_shares") < F.abs(F.col("oi_delta") * z("prev_shares")) * 0.5)
    d = d.withColumn("penalty", F.when(artefact, shrink).otherwise(1.0))
    rank_bonus = F.when(F.col("delta_rank") > 0, 1 + F.least(F.col("delta_rank") / 5, F.lit(1.0))).otherwise(1.0)
    share_bonus = F.when(F.col("delta_shares") > 0, 1 + F.least(F.col("delta_shares") / F.greatest(z("prev_shares"), F.lit(1.0)), F.lit(1.0))).otherwise(1.0)
    entered = (F.col("rank") > 0) & (F.col("rank") <= top) & ((z("prev_rank") == 0) | (z("prev_rank") > top)) & (F.col("delta_shares") >= least)
    level = F.when(F.col("penalty") < 1, "none").when(F.col("pct_oi") >= tiers[2], "critical").when(F.col("pct_oi") >= tiers[1], "warning").when((F.col("pct_oi") >= tiers[0]) | entered, "info").otherwise("none")
    return d.withColumns({"score": 100 * F.col("pct_oi") * rank_bonus * share_bonus * F.col("penalty"), "confidence": F.least(F.lit(1.0), F.col("pct_oi") * 4), "entered_top": entered, "level": level})


def catalyst_window(signals: DataFrame, catalysts: DataFrame, by: str = "event_id", max_boost: float = 12, min_confidence: float = 0.0) -> DataFrame:
    """signals (signal_id, by, at) with the best catalyst (by, kind, expected_at, confidence, pre_h, post_h) whose window holds them.

    Upcoming ones come before past ones; of two upcoming ones the farther, of two past ones the nearer."""
    c = catalysts.where(F.col("confidence") >= min_confidence)
    lead = F.timestamp_diff("SECOND", F.col("at"), F.col("expected_at")) / 3600
    j = signals.join(c, by).withColumn("lead_h", lead).where((F.col("lead_h") >= -F.col("post_h")) & (F.col("lead_h") <= F.col("pre_h")))
    order = [F.when(F.col("lead_h") > 0, 0).otherwise(1), F.desc("lead_h"), "kind", "expected_at"]
    j = j.withColumn("_r", F.row_number().over(Window.partitionBy("signal_id").orderBy(*order))).where("_r = 1").drop("_r")
    side = F.when(F.col("lead_h") >= 0, F.col("pre_h")).otherwise(F.col("post_h"))
    near = F.greatest(F.lit(0.0), 1 - F.abs("lead_h") / F.greatest(side, F.lit(1 / 3600)))
    klass = F.when(F.col("lead_h") >= 0, F.when(F.col("lead_h") > F.col("pre_h") / 2, "pre_long").otherwise("pre_short")).otherwise(F.when(-F.col("lead_h") > F.col("post_h") / 2, "post_long").otherwise("post_short"))
    return j.withColumns({"window_class": klass, "boost": max_boost * F.col("confidence") * near})


def book_bars(levels: DataFrame, seconds: int = 60, depth: int = 5) -> DataFrame:
    """Books (asset, ts, bids, asks as best-first arrays of price and size) to bars: the last book of each window."""
    last = levels.groupBy("asset", F.window("ts", f"{seconds} seconds")["start"].alias("bar_at")).agg(F.max_by(F.struct("bids", "asks"), "ts").alias("_b"))
    deep = lambda c: F.aggregate(F.slice(F.col(c), 1, depth), F.lit(0.0), lambda a, x: a + x["size"])
    d = last.select("asset", "bar_at", F.get("_b.bids", F.lit(0))["price"].alias("bid"), F.get("_b.asks", F.lit(0))["price"].alias("ask"), deep("_b.bids").alias("bid_depth"), deep("_b.asks").alias("ask_depth"))
    total = F.col("bid_depth") + F.col("ask_depth")
    return d.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "imbalance": F.coalesce(F.try_divide(F.col("bid_depth") - F.col("ask_depth"), total), F.lit(0.0))})


def book_vacuum(bars: DataFrame, key: str = "asset", at: str = "bar_at", window: int = 20, collapse: float = 0.5, spread_z: float = 1.5, max_boost: float = 8, bucket_days: int | None = 1, stretch: int = 50_000) -> DataFrame:
    """Depth of one side falls by half from bar to bar, confirmed by the spread or the mid's direction.

    Bars of a key are numbered day by day (bucket_days) and cut into stretches, each with the `window` bars before it, so a
    key of any length is many tasks' work. With bucket_days None keys are taken whole: for short ones, or where `at` is not a time."""
    if bucket_days is None:
        d, w = bars.withColumn("_carried", F.lit(False)), Window.partitionBy(key).orderBy(at)
    else:
        d = stretches(ordinal(bars, [key], [at], days(at, bucket_days), "_place"), "_place", stretch, window)
        w = Window.partitionBy(key, "_stretch").orderBy("_place")
    base = w.rowsBetween(-window, -1)
    fall = lambda c: F.coalesce(-F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)), F.lit(0.0))
    d = d.withColumns({"ask_fall": fall("ask_depth"), "bid_fall": fall("bid_depth"), "mid_delta": F.coalesce(F.col("mid") - F.lag("mid").over(w), F.lit(0.0)),
                          "z": F.coalesce(F.try_divide(F.col("spread") - F.avg("spread").over(base), F.nullif(F.stddev_pop("spread").over(base), F.lit(0.0))), F.lit(0.0))})
    side = F.when((F.col("ask_fall") >= collapse) & (F.col("ask_fall") > F.col("bid_fall")), "ask").when((F.col("bid_fall") >= collapse) & (F.col("bid_fall") > F.col("ask_fall")), "bid")
    d = d.withColumn("side", side).where("side is not null and not _carried").drop("_carried", "_place", "_stretch")
    sure = (F.col("z") >= spread_z) | ((F.col("side") == "ask") & (F.col("mid_delta") > 0)) | ((F.col("side") == "bid") & (F.col("mid_delta") < 0))
    fell = F.greatest("ask_fall", "bid_fall")
    return d.withColumns({"detected": sure, "collapse": fell, "boost": F.when(sure, F.least(F.lit(float(max_boost)), max_boost * fell)).otherwise(0.0)})


def peer_medians(d: DataFrame, by: str, value: str) -> DataFrame:
    """Adds peer_median, of the values of the group's other rows (null ones left out), and n_peers, all of these rows.

    Without a row the middle moves by one place at most, so three values about the middle of the sorted group
    serve all of its rows; rows never meet each other. A null group has no peers and goes."""
    rows = d.where(F.col(by).isNotNull())
    ranked = rows.where(F.col(value).isNotNull()).select(by, value, (F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1).alias("_i"))
    size = rows.groupBy(by).agg(F.count("*").alias("_all"), F.count(value).alias("_n"))
    at = F.floor((F.col("_n") - 2) / 2)
    middle = ranked.join(size.select(by, at.alias("_at")), by).where((F.col("_i") >= F.col("_at")) & (F.col("_i") <= F.col("_at") + 2))
    middle = middle.groupBy(by).agg(*[F.max(F.when(F.col("_i") == F.col("_at") + k, F.col(value))).alias(f"_v{k}") for k in range(3)])
    j = rows.join(size, by).join(middle, by, "left").withColumn("_at", at)
    v = lambda k: F.when(k == 0, F.col("_v0")).when(k == 1, F.col("_v1")).when(k == 2, F.col("_v2"))
    # A value at or below the k-th one of the group is taken out below it: equal values may stand for each other.
    place = lambda k: k + F.when(F.col(value) <= v(k), 1).otherwise(0)
    others = F.col("_n") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    low, high = F.floor((others - 1) / 2) - F.col("_at"), F.ceil((others - 1) / 2) - F.col("_at")
    median = F.when(others > 0, (v(place(low)) + v(place(high))) / 2)
    return j.withColumns({"peer_median": median, "n_peers": F.col("_all") - 1}).drop("_all", "_n", "_at", "_v0", "_v1", "_v2")


def repricing_lag(d: DataFrame, least: float = 3, peers: int = 2, max_ambiguity: float = 0.7) -> DataFrame:
    """d: observed, expected, peer_median, n_peers (cents), ambiguity. Adds lag, bias and level."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lag = F.greatest(z("expected"), z("peer_median")) - z("observed")
    usable = (F.col("ambiguity") < max_ambiguity) & ((z("n_peers") >= peers) | (z("expected") > 0))
    d = d.withColumn("lag", F.when(usable, lag))
    size = F.abs("lag")
    return d.withColumns({"bias": F.when(F.col("lag") >= least, "underreaction").when(-F.col("lag") >= least, "overreaction"),
                          "level": F.when(size >= 3 * least, "critical").when(size >= 2 * least, "warning").when(size >= least, "info").otherwise("none")})


def shadow_state(d: DataFrame, flags: DataFrame) -> DataFrame:
    """Decisions with their strategy's flag and promotion: live, shadow_only or off."""
    j = d.join(flags, "strategy", "left")
    return j.withColumn("state", F.when(~F.coalesce("enabled", F.lit(False)), "off").when(F.coalesce("promoted", F.lit(False)), "live").otherwise("shadow_only"))


def due_events(d: DataFrame, now: Column, categories: tuple[str, ...], volumes: tuple[float, float] = (100_000, 10_000), alerts: int = 3, minutes: tuple[int, int, int] = (5, 15, 60)) -> DataFrame:
    """d: event_id, market_id, category, volume, alerts, fetched_at (null: never). One row for each event that is due.

    A market's tier is 1 by category (part of its name), volume or alerts, 2 by the smaller volume or any alert, else 3;
    it is due when the fetch of its event is as old as the tier's cadence. Of an event's due markets the one
    with the most alerts, then volume, counts."""
    volume, rung = F.coalesce("volume", F.lit(0.0)), F.coalesce("alerts", F.lit(0))
    named = F.lit(False)
    for c in categories:
        named = named | F.coalesce(F.lower("category").contains(c.lower()), F.lit(False))
    tier = F.when(named | (volume >= volumes[0]) | (rung >= alerts), 1).when((volume >= volumes[1]) | (rung >= 1), 2).otherwise(3)
    d = d.withColumn("tier", tier)
    age = F.timestamp_diff("SECOND", F.col("fetched_at"), now)
    cadence = F.when(F.col("tier") == 1, 60 * minutes[0]).when(F.col("tier") == 2, 60 * minutes[1]).otherwise(60 * minutes[2])
    due = d.where(F.col("fetched_at").isNull() | (age >= cadence)).withColumn("_o", F.struct(-rung, -volume, "market_id"))
    return due.groupBy("event_id").agg(F.min_by(F.struct("market_id", "tier"), "_o").alias("_b")).select("event_id", "_b.market_id", "_b.tier")
