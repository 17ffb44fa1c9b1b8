"""Queries over trades: distributions, lines, sides, times, ownership and event flow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeflow.functions import rounding
from tradeflow.functions.bands import lifecycle_pct
from tradeflow.operators import accumulation, flow, scoring
from tradeflow.operators.asof import asof
from tradeflow.plans.named import query
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import ALERTS_SQL, MARKETS_SQL, NOW, PRICES_SQL, TRADES_SQL

OLD = "2000-01-01 00:00:00"
TIES_SQL = "traded_at DESC, notional DESC, order_id, line_no, trader_id, price, side"


def beside(d, one_row):
    """d with the columns of a table of one row."""
    return d.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def rounded(d, *cols, digits: int = 4):
    return d.withColumns({c: rounding.rounded(c, digits) if d.schema[c].dataType == T.DoubleType() else F.round(c, digits) for c in cols})


@query("SELECT severity, count(*) AS n, round(sum(notional), 2) AS usd FROM scored WHERE severity IS NOT NULL GROUP BY severity", ALERTS_SQL)
def severity_counts(t):
    return t.scored.where("severity is not null").groupBy("severity").agg(F.count("*").alias("n"), rounding.rounded(F.sum("notional"), 2).alias("usd"))


@query("""SELECT market_id, outcome, count(*) AS n, round(sum(notional), 2) AS total, round(avg(notional), 8) AS mean, round(quantile_cont(notional, 0.5), 4) AS median, round(quantile_cont(notional, 0.95), 4) AS p95,
  round(quantile_cont(notional, 0.99), 4) AS p99, min(traded_at) AS oldest, max(traded_at) AS newest FROM trades GROUP BY market_id, outcome""", TRADES_SQL)
def baseline_distribution(t):
    return rounded(rounded(flow.distribution(t.trades, ["market_id", "outcome"]), "total", digits=2), "median", "p95", "p99").withColumn("mean", rounding.rounded("mean", 8))


@query("""SELECT k.market_id, k.outcome, coalesce(d.n, 0) AS n, round(coalesce(d.total, 0), 2) AS total, round(coalesce(d.median, 0), 4) AS median, d.oldest FROM (SELECT DISTINCT market_id, outcome FROM trades) k LEFT JOIN
  (SELECT market_id, outcome, count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS median, min(traded_at) AS oldest FROM trades WHERE traded_at >= TIMESTAMP '2001-10-20' GROUP BY ALL) d USING (market_id, outcome)""", TRADES_SQL)
def baseline_distribution_window(t):
    recent = flow.distribution(t.trades, ["market_id", "outcome"], since="2001-10-20 00:00:00").select("market_id", "outcome", "n", "total", "median", "oldest")
    return rounded(rounded(flow.distribution_of(t.trades.select("market_id", "outcome").distinct(), recent, ["market_id", "outcome"]), "total", digits=2), "median")


@query(f"""SELECT market_id, outcome, rank, round(notional, 2) AS notional, traded_at FROM (SELECT *, row_number() OVER (PARTITION BY market_id, outcome ORDER BY {TIES_SQL}) AS rank FROM trades WHERE traded_at >= TIMESTAMP '{OLD}') WHERE rank <= 5""", TRADES_SQL)
def baseline_trades_top(t):
    d = flow.newest(t.trades.where(F.col("traded_at") >= F.to_timestamp_ntz(F.lit(OLD))), ["market_id", "outcome"], 5, [F.desc("traded_at"), F.desc("notional"), "order_id", "line_no", "trader_id", "price", "side"])
    return d.select("market_id", "outcome", "rank", rounding.rounded("notional", 2).alias("notional"), "traded_at")


@query("SELECT market_id, outcome, count(*) AS n, round(sum(notional), 2) AS total, min(traded_at) AS oldest, max(traded_at) AS newest FROM trades GROUP BY ALL", TRADES_SQL)
def baseline_span(t):
    return rounded(flow.span(t.trades, ["market_id", "outcome"]), "total", digits=2)


@query("SELECT trader_id, count(*) AS n, round(sum(notional), 2) AS total, round(avg(notional), 8) AS mean, round(quantile_cont(notional, 0.5), 4) AS median, round(quantile_cont(notional, 0.95), 4) AS p95, round(quantile_cont(notional, 0.99), 4) AS p99, min(traded_at) AS oldest, max(traded_at) AS newest FROM trades GROUP BY ALL", TRADES_SQL)
def trader_stats(t):
    return rounded(rounded(flow.distribution(t.trades, ["trader_id"]), "total", digits=2), "median", "p95", "p99").withColumn("mean", rounding.rounded("mean", 8))


@query("""SELECT trader_id, market_id, outcome, count(*) FILTER (side = 'BUY') AS buy_n, count(*) FILTER (side = 'SELL') AS sell_n, round(coalesce(sum(notional) FILTER (side = 'BUY'), 0), 2) AS buy_usd,
  round(coalesce(sum(notional) FILTER (side = 'SELL'), 0), 2) AS sell_usd FROM trades GROUP BY ALL""", TRADES_SQL)
def trader_side_activity(t):
    return rounded(flow.side_activity(t.trades, ["trader_id", "market_id", "outcome"]), "buy_usd", "sell_usd", digits=2)


@query("""SELECT *, (buy_n >= 2 AND sell_n >= 2 AND abs(buy_usd - sell_usd) / greatest(buy_usd, sell_usd) <= 0.3) AS suppress FROM (SELECT trader_id, market_id, count(*) FILTER (side = 'BUY') AS buy_n, count(*) FILTER (side = 'SELL') AS sell_n,
  round(coalesce(sum(notional) FILTER (side = 'BUY'), 0), 2) AS buy_usd, round(coalesce(sum(notional) FILTER (side = 'SELL'), 0), 2) AS sell_usd FROM trades GROUP BY ALL)""", TRADES_SQL)
def market_maker_filter(t):
    a = rounded(flow.side_activity(t.trades, ["trader_id", "market_id"]), "buy_usd", "sell_usd", digits=2)
    return flow.market_maker(a, per_side=2).drop("imbalance")


@query("""SELECT w.market_id, w.outcome, w.trader_id, round(wallet_buy, 7) AS wallet_buy, round(wallet_sell, 7) AS wallet_sell, round(market_buy, 5) AS market_buy FROM
  (SELECT market_id, outcome, trader_id, coalesce(sum(shares) FILTER (side = 'BUY'), 0) AS wallet_buy, coalesce(sum(shares) FILTER (side = 'SELL'), 0) AS wallet_sell FROM trades GROUP BY ALL) w
  JOIN (SELECT market_id, outcome, coalesce(sum(shares) FILTER (side = 'BUY'), 0) AS market_buy FROM trades GROUP BY ALL) m USING (market_id, outcome)""", TRADES_SQL)
def ownership_shares(t):
    return rounded(flow.ownership(t.trades, ["market_id", "outcome"]).drop("price"), "wallet_buy", "wallet_sell", digits=7).withColumn("market_buy", rounding.rounded("market_buy", 5))


@query("""SELECT market_id, outcome, trader_id, round(share, 4) AS share_pct, round(usd, 2) AS usd, CASE WHEN share >= 2.5 THEN 'critical' WHEN share >= 1.5 THEN 'warning' ELSE 'info' END AS severity FROM
  (SELECT w.*, greatest(wb - ws, 0) * p AS usd, 100 * greatest(wb - ws, 0) / mb AS share FROM
    (SELECT market_id, outcome, trader_id, coalesce(sum(shares) FILTER (side = 'BUY'), 0) AS wb, coalesce(sum(shares) FILTER (side = 'SELL'), 0) AS ws, avg(price) AS p FROM trades GROUP BY ALL) w
    JOIN (SELECT market_id, outcome, sum(shares) FILTER (side = 'BUY') AS mb FROM trades GROUP BY ALL) m USING (market_id, outcome) WHERE mb > 0) WHERE usd >= 10000 AND share >= 1""", TRADES_SQL)
def ownership_concentration(t):
    d = flow.ownership_verdict(flow.ownership(t.trades, ["market_id", "outcome"]), tiers=(1, 1.5, 2.5))
    return d.where("severity is not null").select("market_id", "outcome", "trader_id", rounding.rounded("share_pct", 4).alias("share_pct"), rounding.rounded("usd", 2).alias("usd"), "severity")


@query("SELECT market_id, min(traded_at) AS oldest, max(traded_at) AS newest FROM trades GROUP BY ALL", TRADES_SQL)
def market_trade_bounds(t):
    return t.trades.groupBy("market_id").agg(F.min("traded_at").alias("oldest"), F.max("traded_at").alias("newest"))


@query("""SELECT market_id, outcome, order_id, line_no, trader_id, traded_at, round(notional, 2) AS notional, (SELECT NULL) IS NULL AS ok, max(traded_at) OVER (PARTITION BY market_id, outcome ORDER BY traded_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS previous_at FROM trades""", TRADES_SQL)
def previous_trade(t):
    d = flow.previous(t.trades, ["market_id", "outcome"])
    return d.select("market_id", "outcome", "order_id", "line_no", "trader_id", "traded_at", rounding.rounded("notional", 2).alias("notional"), F.lit(True).alias("ok"), "previous_at")


@query("""SELECT trader_id, market_id, outcome, side, count(*) AS n, round(sum(notional), 2) AS total, round(avg(notional), 8) AS mean, round(quantile_cont(notional, 0.5), 4) AS median, round(max(notional), 2) AS largest, round(min(notional), 2) AS least,
  round(avg(price), 6) AS avg_price, round(min(price), 6) AS min_price, min(traded_at) AS oldest, max(traded_at) AS newest FROM trades GROUP BY ALL""", TRADES_SQL)
def accumulation_line_summary(t):
    d = flow.lines(t.trades, ["trader_id", "market_id", "outcome", "side"]).drop("avg_odds", "max_odds")
    return rounded(rounded(rounded(d, "total", "largest", "least", digits=2), "median").withColumn("mean", rounding.rounded("mean", 8)), "avg_price", "min_price", digits=6)


@query("""SELECT trader_id, market_id, n, round(total, 2) AS total, severity, size_path, round(confidence, 6) AS confidence FROM (
  SELECT *, CASE WHEN n >= 4 AND odds >= 8 AND total * (odds - 1) >= 50000 AND path(100000) IS NOT NULL THEN 'critical' WHEN n >= 3 AND odds >= 5 AND total * (odds - 1) >= 15000 AND path(25000) IS NOT NULL THEN 'warning'
    WHEN n >= 2 AND odds >= 3 AND total * (odds - 1) >= 5000 AND path(10000) IS NOT NULL THEN 'info' END AS severity FROM l)
  WHERE severity IS NOT NULL""".replace("path(100000)", "CASE WHEN total >= 400000 THEN 's' WHEN total >= 200000 AND median >= 60000 THEN 'm' END").replace("path(25000)", "CASE WHEN total >= 100000 THEN 's' WHEN total >= 50000 AND median >= 15000 THEN 'm' END")
       .replace("path(10000)", "CASE WHEN total >= 40000 THEN 's' WHEN total >= 20000 AND median >= 6000 THEN 'm' END")
       .replace("severity, size_path", "severity, CASE severity WHEN 'critical' THEN CASE WHEN total >= 400000 THEN 'many-smalls' ELSE 'meaningful' END WHEN 'warning' THEN CASE WHEN total >= 100000 THEN 'many-smalls' ELSE 'meaningful' END ELSE CASE WHEN total >= 40000 THEN 'many-smalls' ELSE 'meaningful' END END AS size_path"),
       TRADES_SQL + """, l AS (SELECT trader_id, market_id, count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS median, avg(1 / price) AS odds,
  0.2 + 0.3 * least(count(*) / 10, 1) + 0.3 * least(CASE WHEN count(*) >= 2 THEN (epoch(max(traded_at)) - epoch(min(traded_at))) / 3600 ELSE 0 END / 4, 1) AS confidence FROM trades GROUP BY ALL)""")
def accumulation_verdicts(t):
    d = flow.lines(t.trades, ["trader_id", "market_id"]).withColumns({"market_p95": F.lit(0.0), "trader_p95": F.lit(0.0), "lifecycle": F.lit(0.0), "hot": F.lit(False)})
    d = accumulation.verdict(d, scoring.Thresholds.for_driver(), trade_floors=(2, 3, 4)).where("severity is not null")
    return d.select("trader_id", "market_id", "n", rounding.rounded("total", 2).alias("total"), "severity", "size_path", rounding.rounded("confidence", 6).alias("confidence"))


@query("SELECT CASE WHEN l % 5 = 0 THEN 'pending' WHEN l % 5 < 3 THEN 'done' ELSE 'skipped' END AS status, count(*) AS n FROM (SELECT line_no AS l FROM trades) GROUP BY ALL", TRADES_SQL)
def detection_status_breakdown(t):
    status = F.when(F.col("line_no") % 5 == 0, F.lit(None)).when(F.col("line_no") % 5 < 3, "done").otherwise("skipped")
    return t.trades.select(status.alias("s")).groupBy(F.coalesce("s", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM trades t WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.market_id = t.market_id AND a.outcome = t.outcome AND a.trader_id = t.trader_id)", ALERTS_SQL)
def pending_detection_count(t):
    return t.trades.join(t.alerts.select("market_id", "outcome", "trader_id"), ["market_id", "outcome", "trader_id"], "left_anti").agg(F.count("*").alias("n"))


@query("SELECT trader_id, min(traded_at) AS first_seen, max(traded_at) AS last_seen, count(DISTINCT market_id) AS markets FROM trades GROUP BY ALL", TRADES_SQL)
def traders(t):
    return t.trades.groupBy("trader_id").agg(F.min("traded_at").alias("first_seen"), F.max("traded_at").alias("last_seen"), F.count_distinct("market_id").alias("markets"))


@query("""SELECT is_new, dormant, count(*) AS n, round(sum(notional), 2) AS usd FROM (SELECT *, (age <= 168 OR history <= 10) AS is_new, NOT (age <= 168 OR history <= 10) AND coalesce(idle >= 720, false) AND notional >= 5000 AS dormant FROM
  (SELECT notional, (epoch(traded_at) - epoch(min(traded_at) OVER (PARTITION BY trader_id))) / 3600 AS age, count(*) OVER (PARTITION BY trader_id) AS history,
   (epoch(traded_at) - epoch(max(traded_at) OVER (PARTITION BY trader_id ORDER BY traded_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))) / 3600 AS idle FROM trades)) GROUP BY ALL""", TRADES_SQL)
def wallet_age(t):
    return flow.wallet_age(t.trades).groupBy("is_new", "dormant").agg(F.count("*").alias("n"), rounding.rounded(F.sum("notional"), 2).alias("usd"))


@query("""SELECT market_id, outcome, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS stddev, round(min(price), 6) AS low, round(max(price), 6) AS high, round(arg_min(price, (traded_at, order_id, line_no, price)), 6) AS first_price,
  round(arg_max(price, (traded_at, order_id, line_no, price)), 6) AS last_price, round(sum(notional), 2) AS volume, round(coalesce(sum(notional) FILTER (side = 'BUY'), 0), 2) AS buy_volume, round(coalesce(sum(notional) FILTER (side = 'SELL'), 0), 2) AS sell_volume
  FROM trades WHERE traded_at >= TIMESTAMP '2000-01-01' GROUP BY ALL""", TRADES_SQL)
def price_window_stats(t):
    d = flow.price_window(t.trades.where(F.col("traded_at") >= F.to_timestamp_ntz(F.lit(OLD))), ["market_id", "outcome"])
    return rounded(rounded(d, "mean", "stddev", "low", "high", "first_price", "last_price", digits=6), "volume", "buy_volume", "sell_volume", digits=2)


@query(f"SELECT market_id, round(100 * (epoch(TIMESTAMP '{NOW}') - epoch(start_at)) / (epoch(end_at) - epoch(start_at)), 4) AS pct FROM markets WHERE 100 * (epoch(TIMESTAMP '{NOW}') - epoch(start_at)) / (epoch(end_at) - epoch(start_at)) >= 90 ORDER BY pct DESC, market_id LIMIT 50", MARKETS_SQL)
def late_market_candidates(t):
    pct = lifecycle_pct(F.to_timestamp_ntz(F.lit(NOW)), "start_at", "end_at", clamp=False)
    return t.markets.select("market_id", rounding.rounded(pct, 4).alias("pct")).where(F.col("pct") >= 90).orderBy(F.desc("pct"), "market_id").limit(50)


@query("SELECT market_id, outcome, round(arg_max(price, (traded_at, order_id, line_no, price)), 6) AS price, max(traded_at) AS at FROM trades GROUP BY ALL", TRADES_SQL)
def latest_price(t):
    return t.trades.groupBy("market_id", "outcome").agg(rounding.rounded(F.max_by("price", F.struct("traded_at", "order_id", "line_no", "price")), 6).alias("price"), F.max("traded_at").alias("at"))


@query("""SELECT event_id, n, round(buy, 2) AS buy_usd, round(sell, 2) AS sell_usd, round((buy - sell) / (buy + sell), 6) AS imbalance, round(largest, 2) AS largest_trade, top.market_id AS top_market, top.outcome AS top_outcome, top.side AS top_side, round(top.usd, 2) AS top_usd FROM
  (SELECT event_id, sum(k)::BIGINT AS n, coalesce(sum(usd) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(usd) FILTER (side = 'SELL'), 0) AS sell, max(largest) AS largest, arg_max({market_id: market_id, outcome: outcome, side: side, usd: usd}, (usd, market_id, outcome, side)) AS top FROM
   (SELECT event_id, market_id, outcome, side, sum(notional) AS usd, count(*) AS k, max(notional) AS largest FROM trades GROUP BY ALL) GROUP BY event_id)""", TRADES_SQL)
def event_flow(t):
    return rounded(rounded(flow.event_flow(t.trades), "buy_usd", "sell_usd", "largest_trade", "top_usd", digits=2), "imbalance", digits=6)


@query("SELECT event_id, rank, round(notional, 2) AS notional, trader_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY notional DESC, traded_at DESC, order_id, line_no, trader_id, price, side) AS rank FROM trades WHERE notional >= 50000) WHERE rank <= 10", TRADES_SQL)
def event_top_trades(t):
    d = flow.newest(t.trades.where(F.col("notional") >= 50_000), ["event_id"], 10, [F.desc("notional"), F.desc("traded_at"), "order_id", "line_no", "trader_id", "price", "side"])
    return d.select("event_id", "rank", rounding.rounded("notional", 2).alias("notional"), "trader_id")


@query("SELECT event_id, market_id, outcome, side, round(sum(notional), 2) AS usd, count(*) AS n FROM trades GROUP BY ALL", TRADES_SQL)
def event_trades_by_side(t):
    return t.trades.groupBy("event_id", "market_id", "outcome", "side").agg(rounding.rounded(F.sum("notional"), 2).alias("usd"), F.count("*").alias("n"))


@query("SELECT w.id AS window_id, t.outcome, t.side, round(sum(notional), 2) AS usd, count(*) AS n FROM trades t JOIN (SELECT market_id AS id, market_id, end_at - INTERVAL 90 DAY AS since, end_at - INTERVAL 30 DAY AS until FROM markets) w ON t.market_id = w.market_id AND t.traded_at >= w.since AND t.traded_at < w.until GROUP BY ALL", MARKETS_SQL)
def trades_in_windows(t):
    w = t.markets.select(F.col("market_id").alias("window_id"), (F.col("end_at") - F.expr("INTERVAL 90 DAYS")).alias("since"), (F.col("end_at") - F.expr("INTERVAL 30 DAYS")).alias("until"))
    j = t.trades.join(w, (F.col("market_id") == F.col("window_id")) & (F.col("traded_at") >= F.col("since")) & (F.col("traded_at") < F.col("until")))
    return j.groupBy("window_id", "outcome", "side").agg(rounding.rounded(F.sum("notional"), 2).alias("usd"), F.count("*").alias("n"))


@query("SELECT market_id, category_id, trader_id, round(notional, 2) AS notional, traded_at FROM trades JOIN markets USING (market_id, event_id, category_id) WHERE traded_at >= end_at - INTERVAL 31 DAY", MARKETS_SQL)
def cluster_window_trades(t):
    j = t.trades.join(t.markets.select("market_id", "end_at"), "market_id").where(F.col("traded_at") >= F.col("end_at") - F.expr("INTERVAL 31 DAYS"))
    return j.select("market_id", "category_id", "trader_id", rounding.rounded("notional", 2).alias("notional"), "traded_at")


@query("SELECT market_id, outcome, traded_at, round(notional, 2) AS notional, trader_id, order_id, line_no FROM trades t WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.market_id = t.market_id AND a.outcome = t.outcome AND a.trader_id = t.trader_id AND a.sent_at = t.traded_at)", ALERTS_SQL)
def known_trade_keys(t):
    keys = t.alerts.select("market_id", "outcome", "trader_id", F.col("sent_at").alias("traded_at"))
    return t.trades.join(keys, ["market_id", "outcome", "trader_id", "traded_at"], "left_semi").select("market_id", "outcome", "traded_at", rounding.rounded("notional", 2).alias("notional"), "trader_id", "order_id", "line_no")


def _asof_sql(op: str, shift: str) -> str:
    return f"SELECT a.dedup_key, round(p.price, 6) AS price FROM alerts a ASOF LEFT JOIN daily p ON a.market_id = p.market_id AND a.outcome = p.outcome AND a.sent_at {shift} {op} p.at"


@query(_asof_sql("<=", "+ INTERVAL 1 DAY"), ALERTS_SQL + PRICES_SQL)
def price_at_or_after(t):
    a = t.alerts.select("dedup_key", "market_id", "outcome", (F.col("sent_at") + F.expr("INTERVAL 1 DAY")).alias("due"))
    return asof(a, kept(t.daily), ["market_id", "outcome"], "due", "at", ["price"], "forward", unique=True).select("dedup_key", rounding.rounded("price", 6).alias("price"))


@query(_asof_sql(">=", "- INTERVAL 5 DAY"), ALERTS_SQL + PRICES_SQL)
def price_at_or_before(t):
    a = t.alerts.select("dedup_key", "market_id", "outcome", (F.col("sent_at") - F.expr("INTERVAL 5 DAYS")).alias("due"))
    return asof(a, kept(t.daily), ["market_id", "outcome"], "due", "at", ["price"], unique=True).select("dedup_key", rounding.rounded("price", 6).alias("price"))


@query(_asof_sql(">", ""), ALERTS_SQL + PRICES_SQL)
def price_before_strict(t):
    return asof(t.alerts.select("dedup_key", "market_id", "outcome", "sent_at"), kept(t.daily), ["market_id", "outcome"], "sent_at", "at", ["price"], strict=True, unique=True).select("dedup_key", rounding.rounded("price", 6).alias("price"))


@query("""SELECT market_id, outcome, trader_id, order_id, line_no, wakes FROM (SELECT t.*, n >= 1 AND span_h > 0 AND notional >= 10000 AND n / (span_h / 24) <= 10 AND total / (span_h / 24) <= 50000 AND (prev IS NULL OR (epoch(traded_at) - epoch(prev)) / 3600 >= 6) AND notional / median >= 1.5 AS wakes FROM
  (SELECT *, max(traded_at) OVER (PARTITION BY market_id, outcome ORDER BY traded_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prev FROM trades) t
  JOIN (SELECT market_id, outcome, count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS median, (epoch(max(traded_at)) - epoch(min(traded_at))) / 3600 AS span_h FROM trades GROUP BY ALL) b USING (market_id, outcome)) WHERE wakes""", TRADES_SQL)
def quiet_market_wakeups(t):
    b = flow.distribution(t.trades, ["market_id", "outcome"]).select("market_id", "outcome", "n", "total", "median", (F.timestamp_diff("SECOND", "oldest", "newest") / 3600).alias("span_h"))
    d = flow.previous(t.trades, ["market_id", "outcome"], out="last_at").join(b, ["market_id", "outcome"]).withColumn("at", F.col("traded_at"))
    return flow.quiet_wakeup(d, usd_per_day=50_000, multiple=1.5).where("wakes").select("market_id", "outcome", "trader_id", "order_id", "line_no", "wakes")


@query(f"""SELECT alertable, hot, too_late, count(*) AS n FROM (SELECT coalesce(lifecycle >= 75 AND (epoch(traded_at) - epoch(start_at)) / 3600 >= 24, false) AS alertable, coalesce(lifecycle >= 90, false) AS hot, traded_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS too_late FROM
  (SELECT t.traded_at, m.start_at, 100 * (epoch(t.traded_at) - epoch(m.start_at)) / (epoch(m.end_at) - epoch(m.start_at)) AS lifecycle FROM trades t JOIN markets m USING (market_id))) GROUP BY ALL""", MARKETS_SQL)
def alert_gates(t):
    j = t.trades.join(t.markets.select("market_id", "start_at", "end_at"), "market_id").withColumn("lifecycle", lifecycle_pct("traded_at", "start_at", "end_at", clamp=False))
    return scoring.gated(j, NOW, max_lag="30 DAYS").groupBy("alertable", "hot", "too_late").agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN notional < 10000 OR odds < 3 THEN 'below_absolute' WHEN profit < 5000 THEN 'below_payoff' WHEN m_ready AND notional / m_p95 < 0.5 THEN 'below_market_p95' WHEN t_ready AND notional / t_p95 < 0.3 THEN 'below_trader_p95' END AS reason FROM scored WHERE raw_severity IS NULL) GROUP BY ALL", ALERTS_SQL)
def suppression_reasons(t):
    return t.scored.where("raw_severity is null").groupBy("reason").agg(F.count("*").alias("n"))
