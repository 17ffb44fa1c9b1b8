"""The paged feed: cut-off, limits, filters, and a stream's cursor over restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeflow.sources import paged
from tradeflow.streaming import feeds

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    rows = [(m, T0 + timedelta(seconds=i // 3), float(i)) for m, n in (("a", 57), ("b", 5), ("c", 20)) for i in range(n)]
    d = spark.createDataFrame(rows, "m string, at timestamp, x double")
    path = f"file://{tmp_path}/feed"
    paged.publish(d, path, "m", [F.col("at"), F.col("x")], "at", "x")
    return path


def us(s):
    return int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + s * 1_000_000


def test_batches_stop_at_the_cutoff_and_say_what_a_limit_hides(spark, feed):
    got = paged.paged(spark, feed, pageSize=10).groupBy("market").agg(F.count("*").alias("n"), F.max("incomplete").alias("i"), F.max("notional").alias("x")).collect()
    assert {r["market"]: (r["n"], r["i"], r["x"]) for r in got} == {"a": (57, False, 56.0), "b": (5, False, 4.0), "c": (20, False, 19.0)}
    got = paged.paged(spark, feed, pageSize=10, maxPages=2).groupBy("market").agg(F.count("*").alias("n"), F.max("incomplete").alias("i"), F.min("notional").alias("x")).collect()
    assert {r["market"]: (r["n"], r["i"], r["x"]) for r in got} == {"a": (20, True, 37.0), "b": (5, False, 0.0), "c": (20, True, 0.0)}
    assert paged.paged(spark, feed, pageSize=10, maxOffset=25).where("market = 'a'").count() == 30
    got = paged.paged(spark, feed, pageSize=7, maxPages=3, sinceMicros=us(15)).where("market = 'a'").collect()
    assert sorted(r["notional"] for r in got) == [float(i) for i in range(45, 57)] and not any(r["incomplete"] for r in got)
    with feeds.setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        d = paged.paged(spark, feed, pageSize=10).where(F.col("market").isin("b", "c") & (F.col("at_us") >= us(1)))
        assert d.rdd.getNumPartitions() == 2
        assert sorted((r["market"], r["id"]) for r in d.collect()) == [("b", 4), ("b", 5)] + sorted(("c", i) for i in range(4, 21))


def test_a_stream_gives_each_row_once_over_restarts(spark, feed, tmp_path):
    out, progress = f"file://{tmp_path}/out", f"file://{tmp_path}/progress"

    def run():
        d = feeds.drain(paged.paged_stream(spark, feed, pageSize=10), out, "append", progress)
        return sorted((r["market"], r["notional"]) for r in d.collect())

    want = sorted((m, float(i)) for m, n in (("a", 57), ("b", 5), ("c", 20)) for i in range(n))
    assert run() == want and run() == want
    # Later rows: of the newest second already seen, of later ones, and of a new market.
    more = [("a", T0 + timedelta(seconds=18), 1_000.0), ("a", T0 + timedelta(seconds=40), 1_001.0), ("b", T0 + timedelta(seconds=1), 1_002.0), ("d", T0, 1_003.0)]
    d = spark.createDataFrame(more, "m string, at timestamp, x double")
    # Ids go on where the market's stopped.
    paged.publish(d.withColumn("k", F.lit(1)), feed + "-more", "m", [F.col("at")], "at", "x")
    shift = spark.read.parquet(feed + "-more").withColumn("id", F.col("id") + 10_000)
    shift.withColumn("part", F.lit("1")).write.mode("append").partitionBy("market", "part").parquet(feed)
    want = sorted(want + [(m, x) for m, _, x in more])
    assert run() == want and run() == want


def test_markets_share_shelves_and_tasks(spark, tmp_path):
    """Neither files nor tasks grow with the markets; the rows are those of a feed with a folder a market."""
    d = spark.range(3_000).select((F.col("id") % 600).cast("string").alias("m"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("at"), F.col("id").cast("double").alias("x"))
    one, many = f"file://{tmp_path}/own", f"file://{tmp_path}/shelves"
    paged.publish(d.where("id % 600 < 300"), one, "m", [F.col("at"), F.col("x")], "at", "x")
    paged.publish(d, many, "m", [F.col("at"), F.col("x")], "at", "x", shelves=8)
    got, want = paged.paged(spark, many, pageSize=2, maxPages=2), paged.paged(spark, one, pageSize=2, maxPages=2)
    assert want.rdd.getNumPartitions() == 256 and got.rdd.getNumPartitions() == 8 and len(list((tmp_path / "shelves").glob("shelf=*"))) == 8
    assert sorted(map(tuple, got.where("market < 300").collect())) == sorted(map(tuple, want.collect())) and got.count() == 2_400
    with feeds.setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        few = paged.paged(spark, many, pageSize=10).where(F.col("market").isin("7", "450", "none"))
        assert few.rdd.getNumPartitions() <= 3 and few.groupBy("market").count().orderBy("market").collect() == [("450", 5), ("7", 5)]
    assert feeds.drain(paged.paged_stream(spark, many, pageSize=10), f"file://{tmp_path}/out", "append", f"file://{tmp_path}/progress").count() == 3_000


def test_an_empty_feed(spark, tmp_path):
    assert paged.paged(spark, f"file://{tmp_path}/none").count() == 0
