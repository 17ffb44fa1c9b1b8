"""Queries of the learning loop: shadow decisions, promotion, graphs, holders, windows, theses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.operators import detectors, flow, graphs, outcomes, state
from tradeflow.operators.asof import asof
from tradeflow.plans.flow import rounded
from tradeflow.plans.named import query
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import ALERTS_SQL, DECISIONS_SQL, MARKETS_SQL, NOW, PRICES_SQL, TRADES_SQL

LINKS_SQL = ", links AS (SELECT event_id, src, market_id AS dst, 0.7::DOUBLE AS confidence FROM (SELECT event_id, market_id, min(market_id) OVER (PARTITION BY event_id) AS src FROM markets) WHERE market_id <> src)"
LINES_SQL = ", lines AS (SELECT trader_id, market_id, event_id, side, sum(notional) AS usd, count(*) AS n, max(traded_at) AS newest, quantile_cont(notional, 0.5) AS median FROM trades GROUP BY ALL HAVING count(*) >= 2)"
RECENT = "TIMESTAMP '2001-06-01'"


@query("""SELECT strategy, version, level, linkage, grouping_id(strategy, version, level, linkage) AS grain, count(clv_6h) AS n, round(quantile_cont(clv_6h, 0.5), 6) AS median, round(avg(CASE WHEN clv_15m IS NULL OR clv_1h IS NULL AND clv_15m > 0 THEN NULL WHEN clv_15m > 0 AND clv_1h <= 0 THEN 1.0 ELSE 0.0 END), 6) AS reversal,
  round(count(*) / greatest(date_diff('day', min(created_at), max(created_at)), 1), 6) AS per_day FROM (SELECT *, CASE WHEN linked_key IS NOT NULL THEN 'linked' ELSE 'standalone' END AS linkage FROM decisions)
  GROUP BY GROUPING SETS ((strategy, version), (strategy, version, level), (strategy, version, linkage))""", DECISIONS_SQL)
def promotion_samples(t):
    return rounded(outcomes.promotion_samples(t.decisions), "median", "reversal", "per_day", digits=6)


@query("""SELECT strategy, version, bool_or(n >= 30 AND median > 0 AND reversal <= 0.4 AND per_day <= 50 AND grain = 3) AS eligible, bool_or(n >= 30 AND median > 0 AND reversal <= 0.4 AND per_day <= 50 AND grain <> 3) AS one_bucket FROM
  (SELECT strategy, version, grouping_id(strategy, version, level) * 1 + 2 * grouping_id(level) AS grain, count(clv_6h) AS n, quantile_cont(clv_6h, 0.5) AS median, avg(CASE WHEN clv_15m IS NULL OR clv_1h IS NULL AND clv_15m > 0 THEN NULL WHEN clv_15m > 0 AND clv_1h <= 0 THEN 1.0 ELSE 0.0 END) AS reversal, count(*) / greatest(date_diff('day', min(created_at), max(created_at)), 1) AS per_day
   FROM decisions GROUP BY GROUPING SETS ((strategy, version), (strategy, version, level))) GROUP BY ALL""", DECISIONS_SQL)
def promotion_review(t):
    d = outcomes.promotion_samples(t.decisions, {"level": F.col("level")})
    ok = outcomes.eligible()
    return d.groupBy("strategy", "version").agg(F.bool_or(ok & (F.col("grain") == 1)).alias("eligible"), F.bool_or(ok & (F.col("grain") != 1)).alias("one_bucket"))


@query("SELECT strategy, dedup_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY created_at DESC, dedup_key) AS rank FROM decisions) WHERE rank <= 20", DECISIONS_SQL)
def decisions_by_strategy(t):
    return flow.newest(t.unmeasured, ["strategy"], 20, [F.desc("created_at"), "dedup_key"]).select("strategy", "dedup_key", "rank")


@query("SELECT dedup_key FROM decisions WHERE clv_15m IS NULL OR clv_1h IS NULL OR clv_6h IS NULL OR clv_24h IS NULL ORDER BY created_at, dedup_key LIMIT 200", DECISIONS_SQL)
def pending_value_rows(t):
    missing = F.col("clv_15m").isNull() | F.col("clv_1h").isNull() | F.col("clv_6h").isNull() | F.col("clv_24h").isNull()
    return t.decisions.where(missing).orderBy("created_at", "dedup_key").limit(200).select("dedup_key")


@query("SELECT strategy, round(sum(v), 4) AS total, count(v) AS filled FROM (SELECT strategy, coalesce(CASE WHEN market_id % 2 = 0 THEN 1.0 END, clv_6h) AS v FROM decisions) GROUP BY strategy", DECISIONS_SQL)
def fill_values_once(t):
    """Known values stay, others are filled."""
    d = t.decisions.select("strategy", F.coalesce(F.when(F.col("market_id") % 2 == 0, 1.0), F.col("clv_6h")).alias("v"))
    return d.groupBy("strategy").agg(rounding.rounded(F.sum("v"), 4).alias("total"), F.count("v").alias("filled"))


@query("SELECT d.dedup_key, a.outcome_status FROM decisions d JOIN alerts a ON d.linked_key = a.dedup_key WHERE a.outcome_status <> 'unresolved'", DECISIONS_SQL)
def outcome_backfill_linked(t):
    a = t.alerts.where("outcome_status <> 'unresolved'").select(F.col("dedup_key").alias("linked_key"), F.col("outcome_status").alias("found"))
    return t.decisions.where("linked_key is not null").join(a, "linked_key").select("dedup_key", F.col("found").alias("outcome_status"))


@query(f"SELECT d.dedup_key, m.end_at FROM decisions d JOIN markets m USING (market_id) WHERE d.linked_key IS NULL AND m.end_at <= TIMESTAMP '{NOW}' + INTERVAL 28 DAY", DECISIONS_SQL)
def outcome_backfill_standalone(t):
    closed = t.markets.where(F.col("end_at") <= F.to_timestamp_ntz(F.lit(NOW)) + F.expr("INTERVAL 28 DAYS")).select("market_id", "end_at")
    return t.decisions.where("linked_key is null").join(closed, "market_id").select("dedup_key", "end_at")


@query("SELECT event_id, list(market_id ORDER BY market_id) AS markets, count(*) AS n FROM markets GROUP BY event_id HAVING count(*) >= 2", MARKETS_SQL)
def event_grouped_markets(t):
    return t.markets.groupBy("event_id").agg(F.array_sort(F.collect_list("market_id")).alias("markets"), F.count("*").alias("n")).where("n >= 2")


@query("SELECT event_id, src, dst, 'same_event' AS link_type, 'aligned' AS direction, confidence FROM links", MARKETS_SQL + LINKS_SQL)
def market_links(t):
    return graphs.market_links(t.markets)


@query("SELECT DISTINCT a AS market_id, b AS peer FROM (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links)", MARKETS_SQL + LINKS_SQL)
def peer_markets(t):
    l = graphs.market_links(t.markets)
    return l.select(F.col("src").alias("market_id"), F.col("dst").alias("peer")).unionByName(l.select(F.col("dst").alias("market_id"), F.col("src").alias("peer"))).distinct()


COTRADE_SQL = """, seen AS (SELECT DISTINCT side, market_id AS event_id, trader_id FROM trades WHERE traded_at >= TIMESTAMP '2001-08-01'),
  pairs AS (SELECT a.side, a.trader_id AS wallet_a, b.trader_id AS wallet_b, count(*) AS shared FROM seen a JOIN seen b ON a.side = b.side AND a.event_id = b.event_id AND a.trader_id < b.trader_id GROUP BY ALL HAVING count(*) >= 2),
  edges AS (SELECT p.side, wallet_a, wallet_b, shared, shared / greatest(na.n, nb.n) AS similarity FROM pairs p JOIN (SELECT side, trader_id, count(*) AS n FROM seen GROUP BY ALL) na ON na.side = p.side AND na.trader_id = wallet_a JOIN (SELECT side, trader_id, count(*) AS n FROM seen GROUP BY ALL) nb ON nb.side = p.side AND nb.trader_id = wallet_b)"""


def _edges(t):
    recent = t.trades.where(F.col("traded_at") >= F.to_timestamp_ntz(F.lit("2001-08-01 00:00:00")))
    return graphs.co_trade_edges(recent.withColumn("event_id", F.col("market_id")), min_shared=2)


@query("SELECT side, wallet_a, wallet_b, shared, round(similarity, 6) AS similarity FROM edges", TRADES_SQL + COTRADE_SQL)
def co_trade_edges(t):
    return rounded(_edges(t), "similarity", digits=6)


@query("SELECT trader_id, count(*) AS n, round(max(similarity), 6) AS strongest FROM (SELECT wallet_a AS trader_id, similarity FROM edges UNION ALL SELECT wallet_b, similarity FROM edges) GROUP BY trader_id", TRADES_SQL + COTRADE_SQL)
def wallet_edges(t):
    d = graphs.edges_of(kept(_edges(t)), t.stored.select("trader_id").distinct())
    return d.groupBy("trader_id").agg(F.count("*").alias("n"), rounding.rounded(F.max("similarity"), 6).alias("strongest"))


@query("SELECT trader_id, market_id, event_id, side, round(usd, 2) AS usd, n, newest FROM lines", TRADES_SQL + LINES_SQL)
def thesis_lines(t):
    return graphs.thesis_lines(t.trades).select("trader_id", "market_id", "event_id", "side", rounding.rounded("usd", 2).alias("usd"), "n", "newest")


@query("SELECT event_id, trader_id, market_id, side, rank, round(usd, 2) AS usd FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY usd DESC, trader_id, market_id, side) AS rank FROM lines) WHERE rank <= 10", TRADES_SQL + LINES_SQL)
def thesis_lines_of_event(t):
    return flow.newest(graphs.thesis_lines(t.trades), ["event_id"], 10, [F.desc("usd"), "trader_id", "market_id", "side"]).select("event_id", "trader_id", "market_id", "side", "rank", rounding.rounded("usd", 2).alias("usd"))


THESIS_AT = "2001-06-01 00:00:00"
CATALYST_SQL = ", catalysts AS (SELECT event_id, kind, TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * ((event_id * 13) % 300) AS expected_at, 0.4 + (event_id % 6) / 10 AS confidence, 24.0 * 40 AS pre_h, 24.0 * 20 AS post_h FROM (SELECT DISTINCT event_id FROM trades) CROSS JOIN (VALUES ('vote'), ('ruling')) v(kind) WHERE kind = 'vote' OR event_id % 2 = 0)"
BOOSTS_SQL = f""", near AS (SELECT market_id AS src, max(10 * (1 - (epoch(expected_at) - epoch(TIMESTAMP '{THESIS_AT}')) / (30 * 86400)) * confidence) AS points FROM markets JOIN catalysts USING (event_id)
    WHERE confidence >= 0.5 AND expected_at BETWEEN TIMESTAMP '{THESIS_AT}' AND TIMESTAMP '{THESIS_AT}' + INTERVAL 30 DAY GROUP BY ALL),
  late AS (SELECT src, 5 * greatest(0, least(1, max(pct))) AS points FROM (SELECT market_id AS src, market_id FROM markets UNION SELECT src, dst FROM links) JOIN
    (SELECT market_id, (epoch(TIMESTAMP '{THESIS_AT}') - epoch(start_at)) / (epoch(end_at) - epoch(start_at)) AS pct FROM markets) USING (market_id) GROUP BY src)"""


@query("""SELECT trader_id, src, asked_side, breadth, round(aligned, 6) AS aligned, round(opposed, 6) AS opposed, round(consistency, 6) AS consistency, round(score, 6) AS score,
  CASE WHEN breadth >= 2 AND aligned >= 1.5 AND consistency >= 0.75 THEN CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'warning' ELSE 'info' END ELSE 'none' END AS level FROM
  (SELECT *, (breadth * consistency * sqrt(aligned) + coalesce(near.points, 0) + coalesce(late.points, 0)) / (1 + 0.5 * opposed) AS score FROM (SELECT *, coalesce(aligned / nullif(aligned + opposed, 0), 0) AS consistency FROM
  (SELECT a.trader_id, a.src, a.asked_side, count(DISTINCT CASE WHEN NOT against AND x * g.confidence > 0 THEN g.dst END) AS breadth, sum(CASE WHEN against THEN 0 ELSE x * g.confidence END) AS aligned, sum(CASE WHEN against THEN x * g.confidence ELSE 0 END) AS opposed
   FROM (SELECT DISTINCT trader_id, market_id AS src, side AS asked_side FROM lines) a
   JOIN (SELECT DISTINCT market_id AS src, market_id AS dst, 1.0 AS confidence, false AS mirror FROM lines UNION ALL SELECT src, dst, confidence, dst % 3 = 0 FROM links) g ON a.src = g.src
   JOIN (SELECT trader_id, market_id, side, ln(1 + usd / greatest(1000, median)) AS x FROM lines) l ON l.trader_id = a.trader_id AND l.market_id = g.dst, LATERAL (SELECT mirror AND l.side = a.asked_side AS against) GROUP BY ALL)) LEFT JOIN near USING (src) LEFT JOIN late USING (src))""",
       MARKETS_SQL + LINES_SQL.replace("FROM trades GROUP", f"FROM trades WHERE traded_at <= TIMESTAMP '{THESIS_AT}' GROUP") + LINKS_SQL + CATALYST_SQL + BOOSTS_SQL)
def thesis_scores(t):
    """At one moment, over the trades until then; every third market is linked as the mirror of its event's first."""
    at = F.to_timestamp_ntz(F.lit(THESIS_AT))
    lines = kept(graphs.thesis_lines(t.stored.where(F.col("traded_at") <= at)))
    links = graphs.market_links(t.markets).withColumn("direction", F.when(F.col("dst") % 3 == 0, "opposed").otherwise("aligned"))
    d = graphs.thesis_score(lines, links, graphs.thesis_boosts(t.markets, links, _catalysts(t), at))
    return rounded(d.select("trader_id", "src", "asked_side", "breadth", "aligned", "opposed", "consistency", "score", "level"), "aligned", "opposed", "consistency", "score", digits=6)


@query("""SELECT dedup_key, branch, cohort_size, round(avg_similarity, 6) AS avg_similarity, round(CASE branch WHEN 'edge_density' THEN least(6, 6 * avg_similarity * (cohort_size - 1) / 3) ELSE least(3, 3 * (cohort_size - 2) / 3) END, 6) AS boost FROM (
  SELECT dedup_key, 'edge_density' AS branch, cohort_size, avg_similarity FROM dense UNION ALL
  SELECT a.dedup_key, 'fresh_wallet_burst', count(DISTINCT t.trader_id), NULL FROM (SELECT * FROM alerts ANTI JOIN dense USING (dedup_key)) a JOIN trades t ON t.market_id = a.market_id AND t.side = a.side AND t.traded_at <= a.sent_at
    JOIN (SELECT trader_id, min(traded_at) AS first_seen FROM trades GROUP BY trader_id) f ON f.trader_id = t.trader_id WHERE f.first_seen >= a.sent_at - INTERVAL 120 DAY GROUP BY a.dedup_key HAVING count(DISTINCT t.trader_id) >= 3)""", ALERTS_SQL + COTRADE_SQL + """, dense AS (
  SELECT dedup_key, count(*) + 1 AS cohort_size, avg(similarity) AS avg_similarity FROM (SELECT a.dedup_key, p.peer, max(p.similarity) AS similarity FROM alerts a JOIN (SELECT trader_id, peer, max(similarity) AS similarity FROM (SELECT wallet_a AS trader_id, wallet_b AS peer, similarity FROM edges WHERE similarity >= 0.2 UNION ALL SELECT wallet_b, wallet_a, similarity FROM edges WHERE similarity >= 0.2) GROUP BY ALL) p USING (trader_id)
  JOIN trades t ON t.market_id = a.market_id AND t.trader_id = p.peer AND t.side = a.side AND t.traded_at <= a.sent_at AND t.traded_at >= a.sent_at - INTERVAL 30 DAY GROUP BY ALL) GROUP BY dedup_key)""")
def wallet_cohorts(t):
    d = graphs.cohorts(t.alerts, kept(_edges(t)), t.stored, min_similarity=0.2, min_events=2, days=30, fresh_days=120)
    return d.select("dedup_key", "branch", "cohort_size", rounding.rounded("avg_similarity", 6).alias("avg_similarity"), rounding.rounded("boost", 6).alias("boost"))


HOLDERS_SQL = """, snaps AS (SELECT market_id, outcome, trader_id, 1 AS snap, sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END) AS shares FROM trades WHERE traded_at < TIMESTAMP '2001-06-01' GROUP BY ALL UNION ALL SELECT market_id, outcome, trader_id, 2, sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END) FROM trades GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER w AS rank, shares / sum(shares) OVER (PARTITION BY market_id, outcome, snap) AS pct_oi, sum(shares) OVER (PARTITION BY market_id, outcome, snap) AS total_oi FROM snaps WHERE shares > 0 WINDOW w AS (PARTITION BY market_id, outcome, snap ORDER BY shares DESC, trader_id))"""


def _holders(t):
    net = F.sum(F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))).alias("shares")
    keys = ["market_id", "outcome", "trader_id"]
    early = t.trades.where(F.col("traded_at") < F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00"))).groupBy(*keys).agg(net).withColumn("snap", F.lit(1))
    snaps = early.unionByName(t.trades.groupBy(*keys).agg(net).withColumn("snap", F.lit(2))).where("shares > 0")
    return detectors.holder_rank(snaps, ["market_id", "outcome", "snap"])


@query("SELECT market_id, outcome, snap, trader_id, rank, round(shares, 2) AS shares, round(pct_oi, 8) AS pct_oi FROM ranked WHERE rank <= 20", TRADES_SQL + HOLDERS_SQL)
def holder_ranking(t):
    return _holders(t).where("rank <= 20").select("market_id", "outcome", "snap", "trader_id", "rank", rounding.rounded("shares", 2).alias("shares"), rounding.rounded("pct_oi", 8).alias("pct_oi"))


@query("""SELECT market_id, outcome, trader_id, level, round(score, 4) AS score, entered_top FROM (SELECT *, (rank <= 5 AND (prev_rank = 0 OR prev_rank > 5) AND ds >= 1) AS entered_top, CASE WHEN pen < 1 THEN 'none' WHEN pct_oi >= 0.15 THEN 'critical' WHEN pct_oi >= 0.08 THEN 'warning' WHEN pct_oi >= 0.03 OR (rank <= 5 AND (prev_rank = 0 OR prev_rank > 5) AND ds >= 1) THEN 'info' ELSE 'none' END AS level,
  100 * pct_oi * CASE WHEN prev_rank > 0 AND prev_rank > rank THEN 1 + least((prev_rank - rank) / 5, 1) ELSE 1 END * CASE WHEN ds > 0 THEN 1 + least(ds / greatest(ps, 1), 1) ELSE 1 END * pen AS score FROM
  (SELECT *, CASE WHEN oid < -0.05 AND ds < abs(oid * ps) * 0.5 THEN 0.5 ELSE 1.0 END AS pen FROM (SELECT *, shares - ps AS ds, CASE WHEN poi > 0 THEN (total_oi - poi) / poi ELSE 0 END AS oid
   FROM (SELECT *, coalesce(lag(rank) OVER w, 0) AS prev_rank, coalesce(lag(shares) OVER w, 0) AS ps, lag(total_oi) OVER w AS poi FROM ranked WINDOW w AS (PARTITION BY market_id, outcome, trader_id ORDER BY snap)) WHERE snap = 2))) WHERE level <> 'none'""", TRADES_SQL + HOLDERS_SQL)
def holder_deltas(t):
    h = _holders(t)
    prev = h.where("snap = 1").select("market_id", "outcome", "trader_id", F.col("rank").alias("prev_rank"), F.col("shares").alias("prev_shares"), F.col("total_oi").alias("prev_total_oi"))
    d = detectors.holder_delta(h.where("snap = 2").join(prev, ["market_id", "outcome", "trader_id"], "left")).where("level <> 'none'")
    return d.select("market_id", "outcome", "trader_id", "level", rounding.rounded("score", 4).alias("score"), "entered_top")


def _catalysts(t):
    e = t.trades.select("event_id").distinct()
    d = e.withColumn("kind", F.explode(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("vote"), F.lit("ruling"))).otherwise(F.array(F.lit("vote")))))
    at = F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval(((F.col("event_id") * 13) % 300).cast("int"))
    return d.withColumns({"expected_at": at, "confidence": 0.4 + (F.col("event_id") % 6) / 10, "pre_h": F.lit(24.0 * 40), "post_h": F.lit(24.0 * 20)})


@query("""SELECT dedup_key, kind, round(lead_h, 4) AS lead_h, window_class, round(12 * confidence * greatest(0, 1 - abs(lead_h) / CASE WHEN lead_h >= 0 THEN pre_h ELSE post_h END), 6) AS boost FROM (SELECT *, CASE WHEN lead_h >= 0 THEN CASE WHEN lead_h > pre_h / 2 THEN 'pre_long' ELSE 'pre_short' END ELSE CASE WHEN -lead_h > post_h / 2 THEN 'post_long' ELSE 'post_short' END END AS window_class,
  row_number() OVER (PARTITION BY dedup_key ORDER BY CASE WHEN lead_h > 0 THEN 0 ELSE 1 END, lead_h DESC, kind, expected_at) AS r FROM (SELECT a.dedup_key, c.*, (epoch(c.expected_at) - epoch(a.sent_at)) / 3600 AS lead_h FROM alerts a JOIN catalysts c USING (event_id)) WHERE lead_h >= -post_h AND lead_h <= pre_h) WHERE r = 1""", ALERTS_SQL + CATALYST_SQL)
def catalyst_windows(t):
    s = t.alerts.select(F.col("dedup_key").alias("signal_id"), "event_id", F.col("sent_at").alias("at"))
    d = detectors.catalyst_window(s, _catalysts(t))
    return d.select(F.col("signal_id").alias("dedup_key"), "kind", rounding.rounded("lead_h", 4).alias("lead_h"), "window_class", rounding.rounded("boost", 6).alias("boost"))


@query("SELECT event_id, kind, expected_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN kind = 'ruling' THEN 0 ELSE 1 END, expected_at, kind) AS r FROM catalysts) WHERE r = 1", TRADES_SQL + CATALYST_SQL)
def primary_catalyst(t):
    return flow.latest(_catalysts(t), ["event_id"], [F.when(F.col("kind") == "ruling", 0).otherwise(1), "expected_at", "kind"]).select("event_id", "kind", "expected_at")


@query("""SELECT trader_id, market_id, n, round(convexity, 6) AS convexity, round(strength, 6) AS strength, band, level, round(score, 4) AS score FROM (SELECT *, CASE WHEN fp <= 0.05 THEN 'deep_tail' ELSE 'near_tail' END AS band, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 30 THEN 'warning' ELSE 'info' END AS level FROM
  (SELECT trader_id, market_id, count(*) AS n, avg(1 / price) AS convexity, sum(notional) / 2500 AS strength, arg_min(price, (traded_at, order_id, line_no, price)) AS fp, avg(1 / price) * sum(notional) / 2500 * CASE WHEN max(lifecycle) > 0 THEN 0.5 + max(lifecycle) / 200 ELSE 1 END AS score
   FROM scored WHERE price BETWEEN 0.02 AND 0.15 AND notional >= 2500 GROUP BY ALL HAVING count(*) >= 2))""", ALERTS_SQL)
def cheap_tails(t):
    d = detectors.cheap_tail(t.scored, ["trader_id", "market_id"])
    return d.select("trader_id", "market_id", "n", rounding.rounded("convexity", 6).alias("convexity"), rounding.rounded("strength", 6).alias("strength"), "band", "level", rounding.rounded("score", 4).alias("score"))


@query("""SELECT market_id, outcome, action, winner, round(dominance, 6) AS dominance, round(CASE WHEN action LIKE '%suppress_loser' THEN 6.0 WHEN action LIKE 'boost%' THEN 6 * (dominance - 1) / 1.5 ELSE 0 END, 6) AS boost FROM (SELECT *, CASE WHEN action LIKE 'boost%' THEN CASE WHEN a >= b THEN 'A' ELSE 'B' END END AS winner FROM (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 'keep_both' WHEN dominance >= 2.5 THEN 'boost_winner_suppress_loser' WHEN dominance >= 1.5 THEN 'boost_winner_degrade_loser' ELSE 'tag_unresolved' END AS action FROM
  (SELECT *, greatest(a, b) / greatest(least(a, b), 0.01) AS dominance FROM (SELECT market_id, outcome, coalesce(sum(notional) FILTER (side = 'BUY'), 0) / 10000 * CASE WHEN market_id % 7 = 0 THEN 0.6 ELSE 1.0 END AS a, coalesce(sum(notional) FILTER (side = 'SELL'), 0) / 10000 AS b FROM trades GROUP BY market_id, outcome))))""", TRADES_SQL)
def conflict_resolution(t):
    d = flow.side_activity(t.trades, ["market_id", "outcome"]).withColumns({"score_a": F.col("buy_usd") / 10_000, "score_b": F.col("sell_usd") / 10_000, "mm_a": F.col("market_id") % 7 == 0, "mm_b": F.lit(False)})
    return rounded(detectors.conflict(d).select("market_id", "outcome", "action", "winner", "dominance", "boost"), "dominance", "boost", digits=6)


@query("""SELECT market_id, round(observed, 4) AS observed, round(peer_median, 4) AS peer_median, n_peers, round(greatest(0, peer_median) - observed, 4) AS lag, CASE WHEN greatest(0, peer_median) - observed >= 3 THEN 'underreaction' WHEN observed - greatest(0, peer_median) >= 3 THEN 'overreaction' END AS bias FROM
  (SELECT a.market_id, any_value(a.move) AS observed, quantile_cont(b.move, 0.5) AS peer_median, count(*) AS n_peers FROM moves a JOIN moves b ON a.event_id = b.event_id AND a.market_id <> b.market_id GROUP BY a.market_id) WHERE n_peers >= 2""",
       TRADES_SQL + ", moves AS (SELECT market_id, event_id, 100 * (avg(price) FILTER (traded_at >= TIMESTAMP '2001-06-01') - avg(price) FILTER (traded_at < TIMESTAMP '2001-06-01' AND traded_at >= TIMESTAMP '2001-01-01')) AS move FROM trades GROUP BY ALL)")
def repricing_lags(t):
    cut, low = F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00")), F.to_timestamp_ntz(F.lit("2001-01-01 00:00:00"))
    at = F.col("traded_at")
    m = t.trades.groupBy("market_id", "event_id").agg((100 * (F.avg(F.when(at >= cut, F.col("price"))) - F.avg(F.when((at < cut) & (at >= low), F.col("price"))))).alias("move"))
    j = detectors.peer_medians(m, "event_id", "move").withColumnRenamed("move", "observed")
    d = detectors.repricing_lag(j.where("n_peers >= 2").withColumns({"expected": F.lit(0.0), "ambiguity": F.lit(0.0)}))
    return rounded(d.select("market_id", "observed", "peer_median", "n_peers", "lag", "bias"), "observed", "peer_median", "lag")


@query("""SELECT w.event_id, w.market_id, w.outcome, round((c.price - o.price) * 100, 4) AS move_cents, CASE WHEN o.price IS NULL OR c.price IS NULL THEN 'stale_missing_price' ELSE 'closed' END AS status FROM (SELECT k.event_id, k.market_id, k.outcome, min(c.expected_at) AS opened FROM (SELECT DISTINCT event_id, market_id, outcome FROM trades) k JOIN catalysts c USING (event_id) GROUP BY ALL) w
  ASOF LEFT JOIN daily o ON o.market_id = w.market_id AND o.outcome = w.outcome AND w.opened >= o.at ASOF LEFT JOIN daily c ON c.market_id = w.market_id AND c.outcome = w.outcome AND w.opened + INTERVAL 26 DAY >= c.at""", TRADES_SQL + PRICES_SQL + CATALYST_SQL)
def repricing_windows(t):
    k = t.stored.select("event_id", "market_id", "outcome").distinct().join(_catalysts(t).groupBy("event_id").agg(F.min("expected_at").alias("opened")), "event_id")
    k = kept(k.withColumn("due", F.col("opened") + F.expr("INTERVAL 26 DAYS")))
    p = kept(t.daily).withColumnRenamed("price", "base")
    d = asof(asof(k, p, ["market_id", "outcome"], "opened", "at", ["base"]), p.withColumnRenamed("base", "end"), ["market_id", "outcome"], "due", "at", ["end"])
    status = F.when(F.col("base").isNull() | F.col("end").isNull(), "stale_missing_price").otherwise("closed")
    return d.select("event_id", "market_id", "outcome", rounding.rounded((F.col("end") - F.col("base")) * 100, 4).alias("move_cents"), status.alias("status"))


@query("SELECT strategy, state, count(*) AS n FROM (SELECT d.*, CASE WHEN NOT coalesce(f.enabled, false) THEN 'off' WHEN f.promoted THEN 'live' ELSE 'shadow_only' END AS state FROM decisions d LEFT JOIN (VALUES ('thesis', true, true), ('cohort', true, false), ('cheap_tail', false, true)) f(strategy, enabled, promoted) USING (strategy)) GROUP BY ALL", DECISIONS_SQL)
def shadow_states(t):
    flags = t.spark.createDataFrame([("thesis", True, True), ("cohort", True, False), ("cheap_tail", False, True)], "strategy string, enabled boolean, promoted boolean")
    return detectors.shadow_state(t.unmeasured, flags).groupBy("strategy", "state").agg(F.count("*").alias("n"))


@query("""SELECT market_id, min(bucket) AS bucket FROM (
  (SELECT market_id, 1 AS bucket FROM alerts WHERE severity = 'critical' GROUP BY market_id ORDER BY count(*) DESC, market_id LIMIT 10) UNION ALL (SELECT market_id, 2 FROM alerts GROUP BY market_id ORDER BY max(sent_at) DESC, market_id LIMIT 20) UNION ALL
  (SELECT market_id, 3 FROM (SELECT market_id FROM markets WHERE n_trades >= 600 UNION SELECT src FROM links) ORDER BY market_id LIMIT 20) UNION ALL (SELECT market_id, 4 FROM trades GROUP BY market_id ORDER BY sum(notional) DESC, market_id LIMIT 20) UNION ALL
  (SELECT market_id, 5 FROM markets ORDER BY end_at, market_id LIMIT 20) UNION ALL (SELECT market_id, 6 FROM markets ORDER BY market_id LIMIT 30)) GROUP BY market_id""", ALERTS_SQL + LINKS_SQL)
def bucketed_markets(t):
    """Six limited buckets; a market counts in its lowest one."""
    a, m, k = t.alerts, t.markets, "market_id"
    parts = [
        a.where("severity = 'critical'").groupBy(k).agg(F.count("*").alias("o")).orderBy(F.desc("o"), k).limit(10), a.groupBy(k).agg(F.max("sent_at").alias("o")).orderBy(F.desc("o"), k).limit(20),
        m.where("n_trades >= 600").select(k).unionByName(graphs.market_links(m).select(F.col("src").alias(k))).distinct().orderBy(k).limit(20), t.trades.groupBy(k).agg(F.sum("notional").alias("o")).orderBy(F.desc("o"), k).limit(20),
        m.orderBy("end_at", k).limit(20), m.orderBy(k).limit(30)]
    out = None
    for i, p in enumerate(parts, 1):
        p = p.select(k, F.lit(i).alias("bucket"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(k).agg(F.min("bucket").alias("bucket"))
