"""What a feed subscribes to, and what a pass of scoring reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.operators import metrics, selector
from tradeflow.plans.named import query
from tradeflow.sources import paged
from tradeflow.sources.scratch import kept, scratch
from tradeflow.sources.trades import ALERTS_SQL, TRADES_SQL

SINCE = "2001-06-01 00:00:00"
PINS = [" 3 ", "5", "", "5", "8", "no such market"]

BUCKETS_SQL = f""", snapshots AS (SELECT k, event_id, CAST(market_id AS VARCHAR) AS condition_id, end_at - INTERVAL 1 DAY * (k * (market_id % 9)) AS created_at, (market_id + k) % 7 <> 0 AS active,
    CASE WHEN market_id % 5 = 0 THEN ['t' || market_id || '-0', 't' || market_id || '-1', 't' || market_id || '-2'] WHEN market_id % 11 = 0 THEN [] ELSE ['t' || market_id || '-0', 't' || market_id || '-1'] END AS tokens, CASE WHEN market_id % 4 = 0 THEN ['O'] ELSE ['O', 'F' || k] END AS outcomes FROM markets, (SELECT unnest([0, 1]) AS k)),
  newest AS (SELECT condition_id, arg_max({{'event_id': event_id, 'tokens': tokens, 'outcomes': outcomes}}, (created_at, k)) AS s FROM snapshots WHERE active GROUP BY condition_id),
  token AS (SELECT s.event_id AS event_id, condition_id, s.tokens[i] AS token, (i - 1)::INT AS ordinal, coalesce(s.outcomes[i], '') AS outcome FROM (SELECT condition_id, s, unnest(range(1, len(s.tokens) + 1)) AS i FROM newest)),
  offered AS (SELECT unnest(['3', '5', '8', 'no such market']) AS condition_id, 1 AS bucket UNION ALL
    (SELECT CAST(market_id AS VARCHAR) AS c, 2 FROM alerts WHERE sent_at > TIMESTAMP '{SINCE}' GROUP BY market_id ORDER BY count(*) DESC, c LIMIT 10) UNION ALL
    (SELECT CAST(market_id AS VARCHAR) AS c, 3 FROM markets WHERE event_id % 5 = 0 ORDER BY n_trades DESC, c LIMIT 10) UNION ALL
    (SELECT CAST(market_id AS VARCHAR) AS c, 4 FROM alerts WHERE severity = 'critical' GROUP BY market_id ORDER BY max(notional) DESC, c LIMIT 10) UNION ALL
    (SELECT CAST(market_id AS VARCHAR) AS c, 5 FROM markets WHERE event_id % 6 = 1 ORDER BY n_trades DESC, c LIMIT 10) UNION ALL
    (SELECT CAST(market_id AS VARCHAR) AS c, 6 FROM trades WHERE traded_at > TIMESTAMP '{SINCE}' GROUP BY market_id HAVING count(*) >= 20 ORDER BY count(*) DESC, c LIMIT 20)),
  chosen AS (SELECT condition_id, min(bucket) AS bucket FROM offered GROUP BY condition_id ORDER BY bucket, condition_id LIMIT 40),
  held AS (SELECT t.*, bucket FROM token t JOIN chosen USING (condition_id))"""


@query("SELECT event_id, condition_id, token, ordinal, outcome, bucket, (SELECT count(DISTINCT condition_id) FROM held x WHERE x.bucket = held.bucket) AS bucket_markets FROM held", ALERTS_SQL + BUCKETS_SQL)
def subscription_rows(t):
    """Tokens and outcomes of the markets that a live feed should follow: pins first, then five limited buckets."""
    id_of = F.col("market_id").cast("string").alias("condition_id")
    m = kept(t.markets)
    a = t.alerts
    recent = t.stored.where(F.col("traded_at") > F.to_timestamp_ntz(F.lit(SINCE))).groupBy("market_id").agg(F.count("*").alias("rank_by")).where("rank_by >= 20")
    buckets = [
        (1, selector.pins(t.spark, PINS).withColumn("rank_by", F.lit(0)), None),
        (2, a.where(F.col("sent_at") > F.to_timestamp_ntz(F.lit(SINCE))).groupBy("market_id").agg(F.count("*").alias("rank_by")).select(id_of, "rank_by"), 10),
        (3, m.where("event_id % 5 = 0").select(id_of, F.col("n_trades").alias("rank_by")), 10),
        (4, a.where("severity = 'critical'").select(id_of, F.col("notional").alias("rank_by")), 10),
        (5, m.where("event_id % 6 = 1").select(id_of, F.col("n_trades").alias("rank_by")), 10),
        (6, recent.select(id_of, "rank_by"), 20)]
    k = F.col("k")
    name = lambda i: F.concat(F.lit("t"), F.col("market_id").cast("string"), F.lit(f"-{i}"))
    held = F.when(F.col("market_id") % 5 == 0, F.array(name(0), name(1), name(2))).when(F.col("market_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(name(0), name(1)))
    said = F.when(F.col("market_id") % 4 == 0, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.concat(F.lit("F"), k.cast("string"))))
    pages = m.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "event_id", id_of, (F.col("end_at") - F.make_dt_interval(days=(k * (F.col("market_id") % 9)).cast("int"))).alias("created_at"), ((F.col("market_id") + k) % 7 != 0).alias("active"), F.to_json(held).alias("tokens"), F.to_json(said).alias("outcomes"))
    return selector.subscriptions(selector.bucketed(buckets, 40), selector.tokens(pages)).select("event_id", "condition_id", "token", "ordinal", "outcome", "bucket", "bucket_markets")


def _histogram_sql() -> str:
    parts = []
    for name, bounds in metrics.BOUNDS.items():
        parts += [f"SELECT '{name}' AS metric, {float(b)}::DOUBLE AS le, count(*) FILTER ({name} <= {b}) AS n, NULL::DOUBLE AS total, NULL::DOUBLE AS largest FROM v" for b in bounds]
        parts.append(f"SELECT '{name}', NULL, count({name}), round(sum({name}), 2), round(max({name}), 4) FROM v")
    return " UNION ALL ".join(parts)


@query(_histogram_sql(), ALERTS_SQL + """, v AS (SELECT notional AS size_usd, odds, CASE WHEN severity IS NOT NULL THEN CASE WHEN m_ready THEN notional / m_p95 ELSE 0 END END AS market_p95_ratio,
  CASE WHEN severity IS NOT NULL THEN CASE WHEN t_ready THEN notional / t_p95 ELSE 0 END END AS trader_p95_ratio, CASE WHEN severity IS NOT NULL THEN profit END AS profit_if_win_usd FROM scored)""")
def metric_histograms(t):
    """What a scoring pass reports while it writes the trades that fired: no second pass counts anything."""
    fired = F.col("severity").isNotNull()
    ratio = lambda ready, c: F.when(fired, F.when(F.col(ready), F.col(c)).otherwise(0.0))
    seen = {"size_usd": F.col("notional"), "odds": F.col("odds"), "market_p95_ratio": ratio("m_ready", "m_p95_ratio"), "trader_p95_ratio": ratio("t_ready", "t_p95_ratio"), "profit_if_win_usd": F.when(fired, F.col("profit"))}
    scored, report = metrics.observed(t.scored, seen)
    kept(scored.where(fired))
    return metrics.rows(t.spark, report.get).select("metric", "le", "n", rounding.rounded("total", 2).alias("total"), rounding.rounded("largest", 4).alias("largest"))


@query("""SELECT market, count(*) AS n, round(sum(notional), 2) AS total, min(traded_at) AS oldest, (any_value(fresh) >= 250) AS incomplete FROM (SELECT CAST(market_id AS VARCHAR) AS market, notional, traded_at, count(*) OVER (PARTITION BY market_id) AS fresh,
  row_number() OVER (PARTITION BY market_id ORDER BY traded_at DESC, order_id DESC, line_no DESC, notional DESC, price DESC, side DESC) AS r FROM trades WHERE traded_at >= TIMESTAMP '1997-01-01') WHERE r <= 250 GROUP BY market""", TRADES_SQL)
def paged_trades(t):
    """A back-fill of every market through pages of 50, five at most, back to a date; incomplete where the limit hid trades."""
    path = f"{scratch(t.spark)}/feed-{uuid.uuid4().hex}"
    paged.publish(t.trades, path, "market_id", [F.col(c) for c in ("traded_at", "order_id", "line_no", "notional", "price", "side")], "traded_at", "notional", shelves=256)
    since = F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))
    micros = t.spark.range(1).select(F.unix_micros(since.cast("timestamp"))).first()[0]
    d = paged.paged(t.spark, path, pageSize=50, maxPages=5, sinceMicros=micros)
    return d.groupBy("market").agg(F.count("*").alias("n"), rounding.rounded(F.sum("notional"), 2).alias("total"), F.timestamp_micros(F.min("at_us")).cast("timestamp_ntz").alias("oldest"), F.bool_or("incomplete").alias("incomplete"))
