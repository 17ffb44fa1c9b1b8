"""Queries over the event stream's batch form, and streams drained to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeflow.functions import rounding
from tradeflow.operators import detectors
from tradeflow.operators.ranks import days, ordinal, stretches
from tradeflow.plans.named import query
from tradeflow.streaming import feeds


@query("SELECT event_type, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS bar_at, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def event_bars(t):
    return feeds.bars(t.table("events"), "event_type", "value", width="1 hour").select("event_type", F.col("bar_at").cast("timestamp_ntz").alias("bar_at"), "n", rounding.rounded("total", 4).alias("total"), "low", "high")


@query("SELECT event_type, w AS bar_at, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP, to_timestamp(floor(epoch(ts) / 1800) * 1800 - 1800)::TIMESTAMP]) AS w FROM events) GROUP BY ALL")
def sliding_bars(t):
    d = feeds.bars(t.table("events"), "event_type", "value", width="1 hour", slide="30 minutes")
    return d.select("event_type", F.col("bar_at").cast("timestamp_ntz").alias("bar_at"), "n", rounding.rounded("total", 4).alias("total"))


def _books(t):
    """Books laid over events: the value is the mid, five levels each side."""
    v = F.col("value") / 100
    side = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct((v + sign * i * 0.01).alias("price"), (F.col("user_id") % 7 + i).cast("double").alias("size")))
    return t.table("events").select(F.col("event_type").alias("asset"), "ts", side(-1).alias("bids"), side(1).alias("asks"))


@query("SELECT event_type AS asset, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS bar_at, round(arg_max(value, ts) / 100 - 0.01, 6) AS bid, round(arg_max(value, ts) / 100 + 0.01, 6) AS ask, (5 * (arg_max(user_id, ts) % 7) + 15)::DOUBLE AS bid_depth FROM events GROUP BY ALL")
def book_bars(t):
    d = detectors.book_bars(_books(t), seconds=3600)
    return d.select("asset", F.col("bar_at").cast("timestamp_ntz").alias("bar_at"), rounding.rounded("bid", 6).alias("bid"), rounding.rounded("ask", 6).alias("ask"), "bid_depth")


@query("""SELECT asset, bar_at, side, detected, round(collapse, 6) AS collapse FROM (SELECT *, CASE WHEN fall >= 0.5 THEN CASE WHEN seq % 2 = 0 THEN 'ask' ELSE 'bid' END END AS side, fall AS collapse, d > 0 AND seq % 2 = 0 OR d < 0 AND seq % 2 = 1 AS detected FROM
  (SELECT *, coalesce((lag(deep) OVER w - deep) / lag(deep) OVER w, 0) AS fall, coalesce(mid - lag(mid) OVER w, 0) AS d, row_number() OVER w AS seq FROM (SELECT event_type AS asset, ts AS bar_at, 5.0 * (user_id % 7) + 15 AS deep, value / 100 AS mid FROM events) WINDOW w AS (PARTITION BY asset ORDER BY bar_at))) WHERE side IS NOT NULL""")
def book_vacuums(t):
    """Depth falls on one side: the side that a bar's number says, so that both occur; the spread is constant."""
    e = t.table("events").select(F.col("event_type").alias("asset"), F.col("ts").alias("bar_at"), (5.0 * (F.col("user_id") % 7) + 15).alias("deep"), (F.col("value") / 100).alias("mid"))
    placed = ordinal(e, ["asset"], ["bar_at"], days("bar_at", 1), "_place").withColumn("seq", F.col("_place") + 1)
    e = stretches(placed, "_place", 10_000, 1)
    w = Window.partitionBy("asset", "_stretch").orderBy("_place")
    before = F.lag("deep").over(w)
    even = F.col("seq") % 2 == 0
    ratio = F.coalesce(F.col("deep") / before, F.lit(1.0))
    two = e.withColumns({"ratio": ratio, "old_mid": F.coalesce(F.lag("mid").over(w), F.col("mid"))}).where("not _carried")
    # Two bars a row: before and after, each with the untouched side at 1.
    bars = two.select(F.concat_ws("#", "asset", F.col("seq").cast("string")).alias("key"), "asset", F.col("bar_at").alias("shown"), F.explode(F.array(
        F.struct(F.lit(0).alias("bar_at"), F.lit(1.0).alias("ask_depth"), F.lit(1.0).alias("bid_depth"), F.col("old_mid").alias("mid")),
        F.struct(F.lit(1).alias("bar_at"), F.when(even, F.col("ratio")).otherwise(1.0).alias("ask_depth"), F.when(even, 1.0).otherwise(F.col("ratio")).alias("bid_depth"), F.col("mid").alias("mid")))).alias("b"))
    bars = bars.select("key", "asset", "shown", "b.*").withColumn("spread", F.lit(0.02))
    d = detectors.book_vacuum(bars, key="key", bucket_days=None)
    return d.select("asset", F.col("shown").alias("bar_at"), "side", "detected", rounding.rounded("collapse", 6).alias("collapse"))


def _stream(t):
    e = t.table("events")
    return feeds.files(t.spark, f"{t.folder}/event[s].parquet", e.schema, 1)


def _drained(t, stream, mode="append"):
    from tradeflow.sources.scratch import scratch

    name = "s" + uuid.uuid4().hex[:12]
    folder = f"{scratch(t.spark)}/{name}"
    return feeds.drain(stream, f"{folder}/rows", mode, f"{folder}/progress")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id % 10 AS market, date_trunc('minute', ts) AS m FROM events) GROUP BY event_type")
def stream_work_items(t):
    s = _stream(t).withColumn("market", F.col("user_id") % 10)
    return _drained(t, feeds.work_items(s, ["event_type", "market"])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS bars, sum(n)::BIGINT AS n FROM (SELECT event_type, floor(epoch(ts) / 3600) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def stream_bars(t):
    d = _drained(t, feeds.bars(_stream(t), "event_type", "value", width="1 hour"), "complete")
    return d.groupBy("event_type").agg(F.count("*").alias("bars"), F.sum("n").alias("n"))


@query("SELECT event_id, event_type, ts FROM events")
def stream_first_seen(t):
    """A feed that brings every eleventh event again after forty minutes, over several micro-batches: each comes out once."""
    from tradeflow.sources.scratch import scratch

    e = t.table("events")
    again = e.where("event_id % 11 = 0").withColumn("arrival", F.col("ts") + F.expr("INTERVAL 40 MINUTES"))
    at = f"{scratch(t.spark)}/feed-{uuid.uuid4().hex}"
    feeds.replay(e.withColumn("arrival", F.col("ts")).unionByName(again), at, F.col("arrival"))
    s = feeds.files(t.spark, at, again.schema, 1)
    return _drained(t, feeds.first_seen(s, ["event_id"], late="2 hours")).select("event_id", "event_type", "ts")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS before FROM events) WHERE before <> 0 AND abs(value - before) / abs(before) >= 0.5 GROUP BY event_type")
def stream_moves(t):
    """Without a cool-down the triggers are those of a plain comparison with the row before."""
    return _drained(t, feeds.moves(_stream(t), "event_type", "value", least=0.5, cooldown_s=0.0)).groupBy("event_type").agg(F.count("*").alias("n"))
