"""Triggers of many markets: what the state store holds and is asked for follows the buckets, and not the markets."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_streams import RULES, walked

from tradeflow.streaming import feeds, triggers

T0 = datetime(2024, 1, 1)
LATE = timedelta(hours=2)


def rows_of(markets):
    """Some rows a market over four days, all on the minute; a few markets only at the beginning, so that timers alone bring them out."""
    rng, rows = random.Random(7), []
    for m in range(markets):
        at = T0
        for _ in range(rng.randint(1, 2) if m % 10 == 0 else 8):
            at += timedelta(minutes=rng.choice([0, 1, 30, 300, 1_300]))
            rows.append((f"m{m}", at, len(rows), rng.choice(["book"] * 4 + ["trade", "status"]), rng.choice([None, 0.0, 0.5, 0.62, 0.4, 0.9])))
    # What is older than the newest row by no more than rows may be late is due, to the millisecond.
    rows.append(("edge", max(r[1] for r in rows), len(rows), "trade", None))
    rows.append(("end", rows[-1][1] + LATE, len(rows), "book", 1.0))
    return rows


def test_state_of_many_markets_is_held_in_buckets(spark, tmp_path):
    rows, buckets = rows_of(400), 5
    d = spark.createDataFrame(rows, "market string, at timestamp_ntz, id long, kind string, mid double")
    feed, progress = f"file://{tmp_path}/feed", f"file://{tmp_path}/progress"
    feeds.replay(d, feed, F.col("at") + F.make_dt_interval(mins=(20 * (F.col("id") % 4)).cast("int")), days=1)
    stream = triggers.work_queue(feeds.files(spark, feed, d.schema, 1), RULES, late="2 hours", buckets=buckets)
    got, most = [], []
    with feeds.setting(spark, "spark.sql.streaming.stateStore.providerClass", triggers.STORE):
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        most = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sorted((r["market"], r["at"], r["reason"]) for r in got) == [x for x in walked(rows, RULES) if x[1] <= rows[-1][1] - LATE]
    # What waits and what is known: a piece of each for a bucket and batch, where every market had its own.
    assert len(most) > 3 and max(most) <= 4 * buckets


def test_silent_markets_are_forgotten_and_times_are_the_sessions(spark, tmp_path):
    """A bucket that stays silent is woken to forget; times come out as they went in, whatever zone the session is in."""
    rows = [("a", T0, 0, "book", 0.5), ("a", T0 + timedelta(hours=1), 1, "book", 0.9), ("b", T0 + timedelta(days=3), 2, "trade", None), ("b", T0 + timedelta(days=6), 3, "trade", None)]
    d = spark.createDataFrame(rows, "market string, at timestamp_ntz, id long, kind string, mid double")
    feed = f"file://{tmp_path}/feed"
    with feeds.setting(spark, "spark.sql.session.timeZone", "America/New_York"), feeds.setting(spark, "spark.sql.streaming.stateStore.providerClass", triggers.STORE):
        feeds.replay(d, feed, F.col("at"), days=1)
        stream = triggers.work_queue(feeds.files(spark, feed, d.schema, 1), RULES, late="2 hours", buckets=8)
        stream = stream.withColumn("at", F.col("at").cast("timestamp_ntz"))
        got = []
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    assert sorted((r["market"], r["at"], r["reason"]) for r in got) == [("a", T0 + timedelta(hours=1), "book_change"), ("a", T0 + timedelta(hours=1), "price_move"), ("b", T0 + timedelta(days=3), "trade_seen")]
    assert left == 2  # b's one row that waits, and when to look at it
