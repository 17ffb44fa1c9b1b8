"""Co-trading graph, market links, thesis lines and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.functions.bands import lifecycle_pct
from tradeflow.sources.scratch import kept


def co_trade_edges(t: DataFrame, min_shared: int = 3, block: int = 200) -> DataFrame:
    """wallet_a < wallet_b, shared, similarity = shared / max(events of a, events of b), by side.

    Wallets of fewer than min_shared events are in no edge and go first. The wallets of an event are cut into
    blocks; a wallet meets each block of its event once, so an event of any number of wallets is many
    tasks' work, and counts of pairs combine map-side."""
    seen = kept(t.where("trader_id is not null and event_id is not null").select("side", "event_id", "trader_id").distinct())
    n = seen.groupBy("side", "trader_id").agg(F.count("*").alias("n"))
    busy = seen.join(n.where(F.col("n") >= min_shared).drop("n"), ["side", "trader_id"], "left_semi")
    size = busy.groupBy("side", "event_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    r = busy.join(size, ["side", "event_id"]).withColumn("own", F.pmod(F.xxhash64("trader_id"), F.col("blocks")).cast("int"))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("side", "event_id", "trader_id", "own", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"))
    a, b = r.withColumnsRenamed({"trader_id": "wallet_a", "own": "own_a"}), r.withColumnsRenamed({"trader_id": "wallet_b", "own": "own_b"})
    met = a.join(b, ["side", "event_id", "i", "j"]).where("wallet_a < wallet_b and (i = j or own_a <> own_b)")
    pairs = met.groupBy("side", "wallet_a", "wallet_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    j = pairs.join(n.select("side", F.col("trader_id").alias("wallet_a"), F.col("n").alias("na")), ["side", "wallet_a"]).join(n.select("side", F.col("trader_id").alias("wallet_b"), F.col("n").alias("nb")), ["side", "wallet_b"])
    return j.select("side", "wallet_a", "wallet_b", "shared", (F.col("shared") / F.greatest("na", "nb")).alias("similarity"))


def edges_of(edges: DataFrame, wallets: DataFrame) -> DataFrame:
    """Edges that touch a wallet at either end, as (trader_id, peer): a union of two equi-joins, not an OR join."""
    ends = edges.select(F.col("wallet_a").alias("trader_id"), F.col("wallet_b").alias("peer"), "side", "shared", "similarity").unionByName(
        edges.select(F.col("wallet_b").alias("trader_id"), F.col("wallet_a").alias("peer"), "side", "shared", "similarity"))
    return ends.join(wallets, "trader_id")


def market_links(markets: DataFrame, confidence: float = 0.7) -> DataFrame:
    """A star from the first market of each event to the others."""
    w = Window.partitionBy("event_id").orderBy("market_id")
    m = markets.select("event_id", "market_id").withColumn("src", F.first("market_id").over(w))
    return m.where("market_id <> src").select("event_id", "src", F.col("market_id").alias("dst"), F.lit("same_event").alias("link_type"), F.lit("aligned").alias("direction"), F.lit(confidence).alias("confidence"))


def thesis_lines(t: DataFrame, min_trades: int = 2) -> DataFrame:
    return t.groupBy("trader_id", "market_id", "event_id", "side").agg(F.sum("notional").alias("usd"), F.count("*").alias("n"), F.max("traded_at").alias("newest"), F.percentile("notional", F.lit(0.5)).alias("median")).where(F.col("n") >= min_trades)


def thesis_boosts(markets: DataFrame, links: DataFrame, catalysts: DataFrame, at: Column, catalyst: float = 10, life: float = 5, days: int = 30, least: float = 0.5) -> DataFrame:
    """Per source market the points its thesis gains at a moment: src, catalyst_boost, life_boost.

    The best catalyst (event_id, expected_at, confidence) of its event that is sure enough and lies within `days` ahead
    counts linearly by its nearness; of the markets linked to it, and itself, the latest in its life counts by its share."""
    m = markets.select("market_id", "event_id", "start_at", "end_at")
    ahead = F.timestamp_diff("SECOND", at, F.col("expected_at")) / F.lit(86_400.0 * days)
    near = m.join(catalysts.where(F.col("confidence") >= least).withColumn("_ahead", ahead).where("_ahead between 0 and 1"), "event_id")
    near = near.groupBy(F.col("market_id").alias("src")).agg(F.max(catalyst * (1 - F.col("_ahead")) * F.col("confidence")).alias("catalyst_boost"))
    graph = m.select(F.col("market_id").alias("src"), "market_id").unionByName(links.select("src", F.col("dst").alias("market_id"))).distinct()
    late = graph.join(m.select("market_id", lifecycle_pct(at, "start_at", "end_at").alias("_pct")), "market_id").groupBy("src").agg((life * F.coalesce(F.max("_pct"), F.lit(0.0)) / 100).alias("life_boost"))
    return late.join(near, "src", "left").withColumn("catalyst_boost", F.coalesce("catalyst_boost", F.lit(0.0)))


def thesis_score(lines: DataFrame, links: DataFrame, boosts: DataFrame | None = None, min_breadth: int = 2, min_consistency: float = 0.75, min_aligned: float = 1.5, floor: float = 1_000, opposed_penalty: float = 0.5,
                 warning: float = 50, critical: float = 75) -> DataFrame:
    """Per (trader, source market, side): breadth, consistency, aligned and opposed exposure, score, level.

    lines: trader_id, market_id, side, usd, median. links: src, dst, direction, confidence; every market
    is aligned with itself. Exposure is log1p(usd / max(floor, median)). boosts (src, catalyst_boost, life_boost)
    are added to the score before the penalty of opposed exposure."""
    size = F.when(F.col("usd") > 0, F.log1p(F.col("usd") / F.greatest(F.lit(float(floor)), F.coalesce("median", F.lit(0.0))))).otherwise(0.0)
    own = lines.select(F.col("market_id").alias("src"), F.col("market_id").alias("dst")).distinct().withColumns({"direction": F.lit("aligned"), "confidence": F.lit(1.0)})
    graph = own.unionByName(links.where("src <> dst").select("src", "dst", "direction", "confidence"))
    asked = lines.select("trader_id", F.col("market_id").alias("src"), F.col("side").alias("asked_side")).distinct()
    l = lines.select("trader_id", F.col("market_id").alias("dst"), "side", size.alias("x"))
    # A line meets the few sources that lead to its market, then those its wallet trades: never a source's whole star.
    j = l.join(graph, "dst").join(asked, ["trader_id", "src"]).withColumn("w", F.col("x") * F.col("confidence"))
    aligned = (F.col("direction") == "aligned") | ((F.col("direction") == "opposed") & (F.col("side") != F.col("asked_side")))
    opposed = (F.col("direction") == "opposed") & (F.col("side") == F.col("asked_side"))
    d = j.groupBy("trader_id", "src", "asked_side").agg(
        F.sum(F.when(aligned, F.col("w")).otherwise(0.0)).alias("aligned"), F.sum(F.when(opposed, F.col("w")).otherwise(0.0)).alias("opposed"),
        F.count_distinct(F.when(aligned & (F.col("w") > 0), F.col("dst"))).alias("breadth"))
    d = d.withColumn("consistency", F.coalesce(F.try_divide(F.col("aligned"), F.col("aligned") + F.col("opposed")), F.lit(0.0)))
    added = F.lit(0.0)
    if boosts is not None:
        d = d.join(boosts.select("src", "catalyst_boost", "life_boost"), "src", "left")
        added = F.coalesce("catalyst_boost", F.lit(0.0)) + F.coalesce("life_boost", F.lit(0.0))
    d = d.withColumn("score", (F.col("breadth") * F.col("consistency") * F.sqrt("aligned") + added) / (1 + opposed_penalty * F.col("opposed")))
    fired = (F.col("breadth") >= min_breadth) & (F.col("consistency") >= min_consistency) & (F.col("aligned") >= min_aligned)
    return d.withColumn("level", F.when(~fired, "none").when(F.col("score") >= critical, "critical").when(F.col("score") >= warning, "warning").otherwise("info"))


def cohorts(alerts: DataFrame, edges: DataFrame, entries: DataFrame, min_similarity: float = 0.6, min_events: int = 3, days: int = 7, max_boost: float = 6, fresh_days: int = 1, min_burst: int = 3) -> DataFrame:
    """Alerts (dedup_key, market_id, trader_id, side, sent_at) whose peers entered the market on the same side within `days` before;
    where there are none, those with a burst of wallets first seen within `fresh_days` before.

    Columns: dedup_key, branch (edge_density or fresh_wallet_burst), cohort_size, avg_similarity (null of a burst), boost.
    entries: all trades (market_id, trader_id, side, traded_at); a wallet is first seen at its first one."""
    good = edges.where((F.col("similarity") >= min_similarity) & (F.col("shared") >= min_events))
    both = edges_of(good, alerts.select("trader_id").distinct()).groupBy("trader_id", "peer").agg(F.max("similarity").alias("similarity"))
    e = entries.groupBy("market_id", F.col("trader_id").alias("peer"), "side", F.col("traded_at").alias("entered_at")).agg(F.count("*").alias("_k"))
    j = alerts.select("dedup_key", "market_id", "trader_id", "side", "sent_at").join(both, "trader_id").join(e, ["market_id", "peer", "side"])
    j = j.where((F.col("entered_at") <= F.col("sent_at")) & (F.col("entered_at") >= F.col("sent_at") - F.expr(f"INTERVAL {days} DAYS")))
    per = j.groupBy("dedup_key", "peer").agg(F.max("similarity").alias("similarity"))
    d = per.groupBy("dedup_key").agg((F.count("*") + 1).alias("cohort_size"), F.avg("similarity").alias("avg_similarity"))
    dense = d.withColumns({"branch": F.lit("edge_density"), "boost": F.least(F.lit(float(max_boost)), max_boost * F.col("avg_similarity") * (F.col("cohort_size") - 1) / 3)})
    burst = fresh_bursts(alerts.join(dense.select("dedup_key"), "dedup_key", "left_anti"), entries, fresh_days).where(F.col("cohort_size") >= min_burst)
    burst = burst.withColumns({"branch": F.lit("fresh_wallet_burst"), "avg_similarity": F.lit(None).cast("double"),
                               "boost": F.least(F.lit(max_boost / 2), max_boost / 2 * (F.col("cohort_size") - min_burst + 1) / 3)})
    return dense.unionByName(burst).select("dedup_key", "branch", "cohort_size", "avg_similarity", "boost")


def fresh_bursts(alerts: DataFrame, entries: DataFrame, fresh_days: int = 1) -> DataFrame:
    """dedup_key and cohort_size: wallets first seen within `fresh_days` before the alert that entered its market on its
    side by then, the alert's own among them if it is one.

    A wallet is fresh for `fresh_days` only, so of the entries only its first in that time in each market and side are
    joined, by the stretch of time it was first seen in: an alert meets the two stretches its window touches."""
    age = F.expr(f"INTERVAL {fresh_days} DAYS")
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / fresh_days).cast("int")
    seen = entries.groupBy("trader_id").agg(F.min("traded_at").alias("first_seen"))
    e = entries.select("trader_id", "market_id", "side", "traded_at").join(seen, "trader_id").where(F.col("traded_at") <= F.col("first_seen") + age)
    e = e.groupBy("market_id", "side", F.col("trader_id").alias("peer"), F.col("first_seen").alias("peer_seen")).agg(F.min("traded_at").alias("entered_at")).withColumn("_b", stretch(F.col("peer_seen")))
    a = alerts.select("dedup_key", "market_id", "trader_id", "side", "sent_at")
    b = a.withColumn("_b", F.explode(F.sequence(stretch(F.col("sent_at") - age), stretch(F.col("sent_at")))))
    met = b.join(e, ["market_id", "side", "_b"]).where((F.col("peer") != F.col("trader_id")) & (F.col("entered_at") <= F.col("sent_at")) & (F.col("peer_seen") >= F.col("sent_at") - age))
    own = a.join(seen, "trader_id").where((F.col("first_seen") <= F.col("sent_at")) & (F.col("first_seen") >= F.col("sent_at") - age))
    return met.select("dedup_key").unionByName(own.select("dedup_key")).groupBy("dedup_key").agg(F.count("*").alias("cohort_size"))
