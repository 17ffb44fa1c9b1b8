"""Queries over what lay before each row: reservoirs, rolling windows, gates by what was allowed, inputs as loaded by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import compact, rounding
from tradeflow.operators import islands, panes, reservoir, staged
from tradeflow.operators.scoring import Thresholds, may_fire, score
from tradeflow.plans.named import query
from tradeflow.sources.scratch import kept
from tradeflow.sources.trades import ALERTS_SQL, TRADES_SQL, line

#: Newest trades of a key and their greatest age: so that on the driver's trades either bound is met.
SAMPLES, WINDOW = 100, 365
ORDER = ["traded_at", "order_id", "line_no", "notional", "price", "side"]


def _reservoir_sql(**keys: str) -> str:
    """held: every trade with, for each name, the sorted sizes in its key's reservoir before it."""
    lists = ", ".join(f"list({{'v': notional, 'at': traded_at}}) OVER (PARTITION BY {k} ORDER BY {', '.join(ORDER)} ROWS BETWEEN {SAMPLES} PRECEDING AND 1 PRECEDING) AS l_{n}" for n, k in keys.items())
    cut = ", ".join(f"list_sort(list_transform(list_filter(coalesce(l_{n}, []), lambda x: x.at >= traded_at - INTERVAL {WINDOW} DAY), lambda x: x.v)) AS {n}" for n in keys)
    return f""", listed AS (SELECT *, {lists} FROM trades), held AS (SELECT *, {cut} FROM listed)"""


def _rank(v: str, q: float) -> str:
    return f"{v}[greatest(1, least(len({v}), CAST(floor(len({v}) * {q} + 0.5) AS BIGINT)))]"


@query(f"SELECT order_id, line_no, len(m) AS n, round(coalesce(list_sum(m), 0), 2) AS total, {_rank('m', 0.5)} AS p50, {_rank('m', 0.95)} AS p95, {_rank('m', 0.99)} AS p99 FROM held", TRADES_SQL + _reservoir_sql(m="market_id, outcome"))
def baseline_reservoir(t):
    """The baseline that each trade is judged by: the newest trades of its market and outcome, read before it is added."""
    d = reservoir.before(t.stored.select("market_id", "outcome", *ORDER), ["market_id", "outcome"], ORDER, samples=SAMPLES, window_days=WINDOW)
    return d.select("order_id", "line_no", "n", rounding.rounded("total", 2).alias("total"), "p50", "p95", "p99")


@query(f"""SELECT market_id, coalesce(severity, 'none') AS severity, count(*) AS n, round(sum(notional), 2) AS usd FROM (SELECT *, CASE WHEN NOT m_ready AND raw IN ('critical', 'warning') AND NOT (notional >= 100000 AND odds >= 8) THEN 'info' ELSE raw END AS severity FROM (SELECT *, CASE
      WHEN notional >= 100000 AND odds >= 8 AND profit >= 50000 AND (NOT m_ready OR notional / m_p95 >= 1.0) AND (NOT t_ready OR notional / t_p95 >= 0.8) THEN 'critical'
      WHEN notional >= 25000 AND odds >= 5 AND profit >= 15000 AND (NOT m_ready OR notional / m_p95 >= 0.8) AND (NOT t_ready OR notional / t_p95 >= 0.5) THEN 'warning'
      WHEN notional >= 10000 AND odds >= 3 AND profit >= 5000 AND (NOT m_ready OR notional / m_p95 >= 0.5) AND (NOT t_ready OR notional / t_p95 >= 0.3) THEN 'info' END AS raw
  FROM (SELECT *, 1 / price AS odds, notional * (1 / price - 1) AS profit, {_rank('m', 0.95)} AS m_p95, {_rank('w', 0.95)} AS t_p95, len(m) >= 20 AND list_sum(m) >= 1000 AS m_ready, len(w) >= 20 AS t_ready FROM held))) GROUP BY ALL""",
       TRADES_SQL + _reservoir_sql(m="market_id, outcome", w="trader_id"))
def scored_reservoir(t):
    """Verdicts by market where each trade is measured by the reservoirs of its market and its wallet before it."""
    rules = Thresholds.for_driver()
    # A trade travels as one long beside its order, wallets first: then its market asks for no wallet, and of what a wallet says
    # the percentile alone goes on, for trades that may fire and where there are trades enough.
    order, found = [*ORDER[:-1], "sell"], compact.unpack(t.parts)  # purchases come before sales, as by side
    rows = kept(t.narrow(outcome=line()["outcome"], **compact.pack(**t.parts)))
    w = reservoir.before(rows, ["trader_id"], order, samples=SAMPLES, window_days=WINDOW, quantiles=(0.95,), opened=found)
    asks = may_fire(rules, found["notional"], found["price"]) & (F.col("n") >= rules.min_trades)
    w = w.select("market_id", "outcome", "order_id", "word", "odd", F.when(asks, F.col("p95")).alias("t_p95"))
    m = reservoir.before(w, ["market_id", "outcome"], order, samples=SAMPLES, window_days=WINDOW, quantiles=(0.95,), counted=rows, opened=found)
    none = F.lit(None).cast("double")  # no tier asks for a 99th percentile
    m = m.select("market_id", found["notional"].alias("notional"), found["price"].alias("price"), F.col("n").alias("m_count"), F.col("total").alias("m_total"), F.col("p95").alias("m_p95"), none.alias("m_p99"),
                 F.lit(rules.min_trades).alias("t_count"), "t_p95", none.alias("t_p99"))
    d = score(m, rules)
    return d.groupBy("market_id", F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"), rounding.rounded(F.sum("notional"), 2).alias("usd"))


@query("""WITH p AS (SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pane, value FROM events), e AS (SELECT DISTINCT event_type, pane FROM p)
  SELECT e.event_type, to_timestamp((e.pane + 1) * 60)::TIMESTAMP AS end_at, count(*) AS n, count(DISTINCT p.pane) AS panes, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, round(count(*) / 1440.0, 6) AS per_minute
  FROM e JOIN p ON p.event_type = e.event_type AND p.pane BETWEEN e.pane - 1439 AND e.pane GROUP BY e.event_type, e.pane""")
def rolling_windows(t):
    """The day that ends with each active minute, folded from minute panes."""
    d = panes.windows(panes.panes(t.table("events"), ["event_type"], "ts", "value"), ["event_type"], width=1_440)
    return d.select("event_type", F.col("end_at").cast("timestamp_ntz").alias("end_at"), "n", "panes", rounding.rounded("total", 4).alias("total"), "low", "high", rounding.rounded("median", 6).alias("median"), rounding.rounded("per_minute", 6).alias("per_minute"))


@query("""WITH RECURSIVE c AS (SELECT event_type, ts, event_id, CASE WHEN value < 90 THEN 'low' ELSE 'high' END AS code FROM events),
  f AS (SELECT *, lag(code) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM c), g AS (SELECT *, sum(CASE WHEN before = code THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
  e AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY ts, event_id) AS k FROM g),
  w AS (SELECT event_type, run, k, event_id, ts AS last_at, CASE WHEN before IS NULL THEN 'no_prior_semantic' ELSE 'semantic_changed' END AS reason FROM e WHERE k = 1 UNION ALL
    SELECT e.event_type, e.run, e.k, e.event_id, CASE WHEN e.ts - w.last_at >= INTERVAL 3 HOUR THEN e.ts ELSE w.last_at END, CASE WHEN e.ts - w.last_at >= INTERVAL 3 HOUR THEN 'cooldown_elapsed' ELSE 'cooldown_active' END FROM w JOIN e ON e.event_type = w.event_type AND e.run = w.run AND e.k = w.k + 1)
  SELECT event_id, reason <> 'cooldown_active' AS allowed, reason FROM w""")
def semantic_gate(t):
    """Reports that may ship: the conclusion changed, or three hours passed since the same one last shipped."""
    e = t.table("events").withColumn("code", F.when(F.col("value") < 90, "low").otherwise("high"))
    d = islands.semantic_gate(e, "event_type", "ts", "code", ["event_id"], cooldown_s=3 * 3_600, bucket_days=3)
    return d.select("event_id", "allowed", "reason")


LOADED_SQL = """, loaded AS (SELECT market_id, date_trunc('month', traded_at)::TIMESTAMP + INTERVAL 1 MONTH AS loaded_at, trader_id, sum(notional) AS usd FROM trades WHERE (market_id + month(traded_at)) % 3 = 0 GROUP BY ALL),
  versions AS (SELECT DISTINCT market_id, loaded_at FROM loaded), top AS (SELECT market_id, loaded_at, count(*) AS n, arg_min(trader_id, r) AS first, sum(usd) AS usd FROM (SELECT *, row_number() OVER (PARTITION BY market_id, loaded_at ORDER BY usd DESC, trader_id) AS r FROM loaded) WHERE r <= 5 GROUP BY ALL),
  seen AS (SELECT a.dedup_key, a.market_id, a.sent_at, v.loaded_at FROM alerts a ASOF LEFT JOIN versions v ON a.market_id = v.market_id AND a.sent_at >= v.loaded_at),
  said AS (SELECT *, CASE WHEN loaded_at IS NULL THEN 'missing' WHEN sent_at <= loaded_at + INTERVAL 45 DAY THEN 'fresh' ELSE 'stale' END AS state FROM seen)"""


@query("SELECT dedup_key, s.loaded_at, state, CASE WHEN state = 'fresh' THEN n END AS holders, CASE WHEN state = 'fresh' THEN first END AS largest_holder, CASE WHEN state = 'fresh' THEN round(usd, 2) END AS usd FROM said s LEFT JOIN top t ON s.market_id = t.market_id AND s.loaded_at = t.loaded_at", ALERTS_SQL + LOADED_SQL)
def staged_holders(t):
    """The five largest holders that an alert could read: of the newest load before it, if that is at most 45 days old."""
    month = F.date_trunc("month", "traded_at").cast("timestamp_ntz") + F.expr("INTERVAL 1 MONTH")
    loaded = t.stored.where((F.col("market_id") + F.month("traded_at")) % 3 == 0).groupBy("market_id", month.alias("loaded_at"), "trader_id").agg(F.sum("notional").alias("usd"))
    a = t.alerts.select("dedup_key", "market_id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))
    d = staged.staged(a, loaded, ["market_id"], "sent_at", "loaded_at", ["trader_id", "usd"], [F.desc("usd"), F.col("trader_id")], "45 DAYS", 5)
    total = F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["usd"])
    return d.select("dedup_key", "loaded_at", "state", F.when(F.col("rows").isNotNull(), F.size("rows")).cast("long").alias("holders"), F.get("rows", F.lit(0))["trader_id"].alias("largest_holder"), rounding.rounded(F.when(F.col("rows").isNotNull(), total), 2).alias("usd"))
