"""Queries that look at nothing later than what they judge: baselines before a trade, tiers of events to fetch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import compact, rounding
from tradeflow.operators import baselines, detectors
from tradeflow.operators.scoring import Thresholds, may_fire, score
from tradeflow.plans.named import query
from tradeflow.sources.trades import ALERTS_SQL, TRADES_SQL, line

BEFORE_SQL = """, p AS (SELECT *, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(traded_at AS DATE)) / 28) AS INTEGER) AS period FROM trades),
  mb AS (SELECT a.market_id, a.outcome, a.period, count(*) AS n, sum(notional) AS total, quantile_cont(notional, 0.5) AS p50, quantile_cont(notional, 0.95) AS p95, quantile_cont(notional, 0.99) AS p99, min(traded_at) AS oldest
    FROM (SELECT DISTINCT market_id, outcome, period FROM p) a JOIN p b ON a.market_id = b.market_id AND a.outcome = b.outcome AND b.period BETWEEN a.period - 13 AND a.period - 1 GROUP BY ALL),
  tb AS (SELECT a.trader_id, a.period, count(*) AS n, quantile_cont(notional, 0.95) AS p95 FROM (SELECT DISTINCT trader_id, period FROM p) a JOIN p b ON a.trader_id = b.trader_id AND b.period BETWEEN a.period - 13 AND a.period - 1 GROUP BY ALL)"""


@query("SELECT market_id, outcome, period, n, round(total, 2) AS total, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99, oldest FROM mb", TRADES_SQL + BEFORE_SQL)
def baseline_before(t):
    d = baselines.before(t.trades, ["market_id", "outcome"])
    return d.select("market_id", "outcome", "period", "n", rounding.rounded("total", 2).alias("total"), *[rounding.rounded(c, 4).alias(c) for c in ("p50", "p95", "p99")], "oldest")


@query("""SELECT market_id, coalesce(severity, 'none') AS severity, count(*) AS n, round(sum(notional), 2) AS usd FROM (SELECT *, CASE WHEN NOT m_ready AND raw IN ('critical', 'warning') AND NOT (notional >= 100000 AND odds >= 8) THEN 'info' ELSE raw END AS severity FROM (SELECT *, CASE
      WHEN notional >= 100000 AND odds >= 8 AND profit >= 50000 AND (NOT m_ready OR notional / m_p95 >= 1.0) AND (NOT t_ready OR notional / t_p95 >= 0.8) THEN 'critical'
      WHEN notional >= 25000 AND odds >= 5 AND profit >= 15000 AND (NOT m_ready OR notional / m_p95 >= 0.8) AND (NOT t_ready OR notional / t_p95 >= 0.5) THEN 'warning'
      WHEN notional >= 10000 AND odds >= 3 AND profit >= 5000 AND (NOT m_ready OR notional / m_p95 >= 0.5) AND (NOT t_ready OR notional / t_p95 >= 0.3) THEN 'info' END AS raw
  FROM (SELECT p.*, 1 / price AS odds, notional * (1 / price - 1) AS profit, mb.p95 AS m_p95, tb.p95 AS t_p95, coalesce(mb.n >= 20 AND mb.total >= 1000 AND mb.p95 > 0, false) AS m_ready, coalesce(tb.n >= 20 AND tb.p95 > 0, false) AS t_ready
    FROM p LEFT JOIN mb ON p.market_id = mb.market_id AND p.outcome = mb.outcome AND p.period = mb.period LEFT JOIN tb ON p.trader_id = tb.trader_id AND p.period = tb.period))) GROUP BY ALL""", TRADES_SQL + BEFORE_SQL)
def scored_before(t):
    """Verdicts by market where each trade is measured against trades before its period only."""
    rules = Thresholds.for_driver()
    # Trades are sent to their order, their wallet and their market, once each and with no more than the rules ask for, in one long
    # where it holds that; those that cannot fire are counted and enter baselines, and take none with them.
    own = line()
    parts = {**{k: t.parts[k] for k in ("notional", "price")}, "period": compact.number(baselines.period(own["traded_at"], 28), 12, "int")}
    d = t.narrow(outcome=own["outcome"], **compact.pack(**parts)).drop("order_id")
    found = compact.unpack(parts)
    opened = {k: found[k] for k in ("notional", "period")}
    judged = may_fire(rules, found["notional"], found["price"])
    # Of a wallet's baseline its percentile alone goes on, where it has trades enough.
    d = baselines.beside(d, ["trader_id"], "t", asks=judged & (F.col("t_count") >= rules.min_trades), opened=opened).drop("trader_id", "t_count", "t_total")
    d = baselines.beside(d, ["market_id", "outcome"], "m", asks=judged, opened=opened)
    none = F.lit(None).cast("double")  # no tier asks for a 99th percentile
    d = score(d.withColumns({"notional": found["notional"], "price": found["price"], "t_count": F.lit(rules.min_trades), "m_p99": none, "t_p99": none}), rules)
    return d.groupBy("market_id", F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"), rounding.rounded(F.sum("notional"), 2).alias("usd"))


AT = "2001-06-01 00:00:00"
TIERS_SQL = f""", traffic AS (SELECT t.market_id, t.event_id, r.r_name AS category, sum(t.notional) AS volume FROM trades t JOIN region r ON t.category_id = r.r_regionkey WHERE traded_at > TIMESTAMP '{AT}' - INTERVAL 7 DAY AND traded_at <= TIMESTAMP '{AT}' GROUP BY ALL),
  rung AS (SELECT market_id, count(*) AS n FROM alerts WHERE sent_at > TIMESTAMP '{AT}' - INTERVAL 7 DAY AND sent_at <= TIMESTAMP '{AT}' GROUP BY market_id),
  cand AS (SELECT event_id, market_id, volume, coalesce(n, 0) AS alerts, CASE WHEN lower(category) LIKE '%asia%' OR volume >= 100000 OR coalesce(n, 0) >= 3 THEN 1 WHEN volume >= 10000 OR coalesce(n, 0) >= 1 THEN 2 ELSE 3 END AS tier,
    CASE WHEN event_id % 4 <> 0 THEN TIMESTAMP '{AT}' - INTERVAL 1 MINUTE * ((event_id * 7) % 90) END AS fetched_at FROM traffic LEFT JOIN rung USING (market_id))"""


@query(f"""SELECT event_id, market_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY alerts DESC, volume DESC, market_id) AS r FROM cand
  WHERE fetched_at IS NULL OR TIMESTAMP '{AT}' - fetched_at >= CASE tier WHEN 1 THEN INTERVAL 5 MINUTE WHEN 2 THEN INTERVAL 15 MINUTE ELSE INTERVAL 60 MINUTE END) WHERE r = 1""", ALERTS_SQL + TIERS_SQL)
def catalyst_tiers(t):
    """Events whose page is due by the tier of their markets, with the market that made them due."""
    at = F.to_timestamp_ntz(F.lit(AT))
    week = lambda c: (F.col(c) > at - F.expr("INTERVAL 7 DAYS")) & (F.col(c) <= at)
    names = t.table("region").select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("category"))
    d = t.trades.where(week("traded_at")).groupBy("market_id", "event_id", "category_id").agg(F.sum("notional").alias("volume")).join(names, "category_id")
    d = d.join(t.alerts.where(week("sent_at")).groupBy("market_id").agg(F.count("*").alias("alerts")), "market_id", "left")
    last = F.when(F.col("event_id") % 4 != 0, at - F.make_dt_interval(mins=((F.col("event_id") * 7) % 90).cast("int")))
    return detectors.due_events(d.withColumn("fetched_at", last), at, categories=("asia",)).select("event_id", "market_id", "tier")
