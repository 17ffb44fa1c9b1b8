"""Streams with state over several micro-batches: the events table replayed as a feed would bring it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeflow.functions.rounding import rounded
from tradeflow.plans.named import query
from tradeflow.sources.scratch import scratch
from tradeflow.streaming import feeds, leases, triggers

#: Cool-downs and silence in seconds, for a feed of some two events a market and day; how late rows may come, in hours. A move from
#: nothing counts, as the SQL's division has it.
RULES = triggers.Rules(least=0.5, reprice_s=12 * 3_600, refresh_s=36 * 3_600, idle_s=48 * 3_600, from_zero=True)
LATE_H = 2


def folder(t) -> str:
    return f"{scratch(t.spark)}/feed-{uuid.uuid4().hex}"


def replayed(t, rows, arrival, name: str, into: str):
    """rows as a stream, a micro-batch for each five days of arrival."""
    feeds.replay(rows, f"{into}/{name}", arrival)
    return feeds.files(t.spark, f"{into}/{name}", rows.schema, 1)


def delayed(minutes):
    return F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'status' ELSE 'book' END AS kind, value AS mid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
    FROM events WHERE (epoch_us(ts) + 999) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - {LATE_H * 3_600_000}),
  s AS (SELECT user_id, k, ts, kind, CASE WHEN kind = 'book' THEN mid END AS mid, NULL::TIMESTAMP AS repriced, NULL::TIMESTAMP AS refreshed, NULL::DOUBLE AS change, false AS again FROM e WHERE k = 1
    UNION ALL SELECT user_id, k, ts, kind, CASE WHEN kind = 'book' THEN mid ELSE before END, CASE WHEN move THEN ts ELSE rp END, CASE WHEN move AND free THEN ts ELSE rf END, CASE WHEN move THEN abs(mid - before) / before END, move AND free
      FROM (SELECT *, kind = 'book' AND before IS NOT NULL AND mid > 0 AND abs(mid - before) / before >= {RULES.least} AND (rp IS NULL OR ts - rp >= INTERVAL {int(RULES.reprice_s)} SECOND) AS move, (rf IS NULL OR ts - rf >= INTERVAL {int(RULES.refresh_s)} SECOND) AS free
        FROM (SELECT e.*, CASE WHEN e.ts - s.ts < INTERVAL {int(RULES.idle_s)} SECOND THEN s.mid END AS before, CASE WHEN e.ts - s.ts < INTERVAL {int(RULES.idle_s)} SECOND THEN s.repriced END AS rp, CASE WHEN e.ts - s.ts < INTERVAL {int(RULES.idle_s)} SECOND THEN s.refreshed END AS rf FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))),
  q AS (SELECT user_id, min(ts) AS queued_at, reason, priority, NULL::DOUBLE AS change FROM (SELECT user_id, ts, CASE kind WHEN 'trade' THEN 'trade_seen' ELSE 'market_status' END AS reason, CASE kind WHEN 'trade' THEN 3 ELSE 1 END AS priority FROM s WHERE kind <> 'book') GROUP BY user_id, reason, priority, date_trunc('minute', ts)
    UNION ALL SELECT user_id, ts, 'price_move', 2, change FROM s WHERE change IS NOT NULL UNION ALL SELECT user_id, ts, 'book_change', 4, change FROM s WHERE again)
  SELECT CAST(user_id AS VARCHAR) AS market, queued_at, reason, priority, round(change, 6) AS change FROM q""")
def stream_triggers(t):
    """Queue rows of a feed whose rows come up to an hour out of order: state crosses batches and expires."""
    e = t.table("events")
    kind = F.when(F.col("event_type") == "purchase", "trade").when(F.col("event_type") == "signup", "status").otherwise("book")
    at = folder(t)
    s = replayed(t, e.select("event_id", "ts", "user_id", "event_type", "value"), delayed(10 * (F.col("event_id") % 7)), "events", at)
    s = s.select(F.col("user_id").alias("market"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("value").alias("mid"))
    with feeds.setting(t.spark, "spark.sql.streaming.stateStore.providerClass", triggers.STORE):
        d = feeds.drain(triggers.work_queue(s, RULES, late=f"{LATE_H} hours"), f"{at}/rows", "append", f"{at}/progress")
    return d.select("market", F.col("at").cast("timestamp_ntz").alias("queued_at"), "reason", "priority", rounded(F.col("change"), 6).alias("change"))


@query("""SELECT event_id, ts < max(newest) OVER (ORDER BY slice RANGE UNBOUNDED PRECEDING) - INTERVAL 2 DAY AS late FROM (SELECT event_id, ts, slice, max(ts) OVER (PARTITION BY slice) AS newest FROM
  (SELECT event_id, ts, floor(epoch_us(ts + CASE WHEN event_id % 13 = 0 THEN INTERVAL 8 DAY WHEN event_id % 5 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END) / 432000000000) AS slice FROM events))""")
def stream_late(t):
    """Every event is stored; those two days and more behind the newest seen are kept out of the alerts' table."""
    e = t.table("events")
    at = folder(t)
    s = replayed(t, e, delayed(F.when(F.col("event_id") % 13 == 0, 8 * 1_440).when(F.col("event_id") % 5 == 0, 30).otherwise(0)), "events", at)
    leases.split_late(s, "ts", "2 days", f"{at}/rows", f"{at}/progress")
    fresh = leases.stored(t.spark, f"{at}/rows/fresh", e.schema).select(F.col("event_id").alias("_id"))
    d = leases.stored(t.spark, f"{at}/rows/stored", e.schema).join(fresh, F.col("event_id") == F.col("_id"), "left")
    return d.select("event_id", F.col("_id").isNull().alias("late"))


@query("""WITH c AS (SELECT event_id AS item, ts AS claimed_at, event_id % 4 AS attempt FROM events WHERE event_type <> 'error'), r AS (SELECT event_id AS item, ts + INTERVAL 1 MINUTE * ((event_id * 37) % 150) AS result_at FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0),
  w AS (SELECT least((SELECT max(claimed_at) FROM c), (SELECT max(result_at) FROM r)) - INTERVAL 10 MINUTE AS mark)
  SELECT item, claimed_at, CASE WHEN result_at IS NULL THEN 'expired' ELSE 'done' END AS status, result_at, CASE WHEN result_at IS NULL AND attempt < 3 THEN (attempt + 1)::INT END AS next_attempt
  FROM (SELECT c.*, r.result_at FROM c LEFT JOIN r ON c.item = r.item AND r.result_at >= c.claimed_at AND r.result_at <= c.claimed_at + INTERVAL 60 MINUTE), w WHERE result_at IS NOT NULL OR claimed_at + INTERVAL 60 MINUTE < mark""")
def stream_leases(t):
    """Claims of queue items with their results; a claim whose hour passes without one expires and its item is queued again."""
    e = t.table("events").where("event_type <> 'error'")
    at = folder(t)
    claims = e.select(F.col("event_id").alias("item"), F.col("ts").alias("claimed_at"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    results = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("item"), delayed((F.col("event_id") * 37) % 150).alias("result_at"))
    c, r = replayed(t, claims, F.col("claimed_at"), "claims", at), replayed(t, results, F.col("result_at"), "results", at)
    d = feeds.drain(leases.leased(c, r, ttl="60 minutes", late="10 minutes"), f"{at}/rows", "append", f"{at}/progress")
    again = leases.queued_again(d).select(F.col("item").alias("_item"), F.col("attempt").alias("next_attempt"))
    d = d.join(again, F.col("item") == F.col("_item"), "left")
    return d.select("item", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at"), "status", F.col("result_at").cast("timestamp_ntz").alias("result_at"), "next_attempt")
