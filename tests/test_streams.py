"""Streams with state over several micro-batches: order, expiry, late rows, leases, restarts and batches that run again."""

import math
import os
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeflow.operators import metrics
from tradeflow.streaming import feeds, leases, triggers

T0 = datetime(2024, 1, 1)
RULES = triggers.Rules(least=0.2, reprice_s=3_600, refresh_s=4 * 3_600, idle_s=20 * 3_600)


def market_rows(n=160):
    rng = random.Random(3)
    rows, at = [], T0
    for i in range(n):
        at += timedelta(minutes=rng.choice([1, 5, 20, 55, 300]))
        if rng.random() < 0.02:
            at += timedelta(hours=30)
        rows.append((rng.choice("ab"), at, i, rng.choice(["book"] * 5 + ["trade", "status"]), rng.choice([None, 0.0, 0.5, 0.62, 0.4, 0.9])))
    return rows


def walked(rows, rules):
    """Queue rows of all rows, worked out plainly."""
    out, mid, seen, price, refresh, minute = [], {}, {}, {}, {}, set()
    for m, at, _, kind, x in sorted(rows, key=lambda r: (r[1], r[2])):
        if m in seen and (at - seen[m]).total_seconds() >= rules.idle_s:
            mid.pop(m, None), price.pop(m, None), refresh.pop(m, None)
        seen[m] = at

        def add(reason, m=m, at=at):
            if (m, reason, at.replace(second=0, microsecond=0)) not in minute:
                minute.add((m, reason, at.replace(second=0, microsecond=0)))
                out.append((m, at, reason))

        if kind == "trade":
            add("trade_seen")
        elif kind == "status":
            add("market_status")
        elif x is not None:
            old = mid.get(m)
            if x > 0 and old is not None and old > 0 and abs(x - old) / old >= rules.least and not (m in price and (at - price[m]).total_seconds() < rules.reprice_s):
                add("price_move")
                price[m] = at
                if not (m in refresh and (at - refresh[m]).total_seconds() < rules.refresh_s):
                    add("book_change")
                    refresh[m] = at
            mid[m] = x
    return sorted(out)


@pytest.mark.parametrize("from_zero", [False, True])
def test_a_move_from_nothing_is_without_bounds_where_it_counts(from_zero):
    market, out, known = triggers._Market(triggers.Rules(least=0.5, from_zero=from_zero)), [], None
    for i, mid in enumerate([0.0, 0.0, 2.0, -1.0, 3.0]):
        known = market._step("m", (i + 1) * 3_600_000_000, "book", mid, known, out)
    assert [(x[2], x[6]) for x in out] == ([("price_move", math.inf), ("book_change", math.inf)] if from_zero else [])


def test_triggers_over_batches_and_a_restart(spark, tmp_path):
    rows = market_rows()
    schema = "market string, at timestamp_ntz, id long, kind string, mid double"
    d = spark.createDataFrame(rows, schema).withColumn("arrival", F.col("at") + F.make_dt_interval(mins=(20 * (F.col("id") % 4)).cast("int")))
    feed, out, progress = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "progress"))
    stream = lambda: triggers.work_queue(feeds.files(spark, feed, d.schema, 1), RULES, late="2 hours")
    half = rows[len(rows) // 2][1]
    with feeds.setting(spark, "spark.sql.streaming.stateStore.providerClass", triggers.STORE):
        feeds.replay(d.where(F.col("arrival") < F.lit(half)), feed, F.col("arrival"), days=1)
        first = feeds.drain(stream(), out, "append", progress).count()
        feeds.replay(d.where(F.col("arrival") >= F.lit(half)), feed, F.col("arrival"), days=1)
        got = feeds.drain(stream(), out, "append", progress)
    have = sorted((r["market"], r["at"], r["reason"]) for r in got.collect())
    mark = max(r[1] for r in rows) - timedelta(hours=2)
    want = [x for x in walked(rows, RULES) if x[1] <= mark]
    assert 0 < first < len(have) and have == want
    assert {x[2] for x in want} == set(triggers.PRIORITY)
    assert all(r["priority"] == triggers.PRIORITY[r["reason"]] and (r["change"] is None) == (r["reason"] in ("trade_seen", "market_status")) for r in got.collect())


def test_late_rows_are_stored_but_not_fresh(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=i), T0 + timedelta(hours=i + (60 if i % 7 == 0 else 0))) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, at timestamp_ntz, arrival timestamp_ntz")
    feed, out, progress = f"file://{tmp_path}/feed", f"file://{tmp_path}/out", f"file://{tmp_path}/progress"

    def run():
        leases.split_late(feeds.files(spark, feed, d.schema, 1), "at", "24 HOURS", out, progress)
        read = lambda name: sorted(r["id"] for r in leases.stored(spark, f"{out}/{name}", d.schema).collect())
        return read("stored"), read("fresh")

    feeds.replay(d.where("id < 100"), feed, F.col("arrival"), days=1)
    run()
    feeds.replay(d.where("id >= 100"), feed, F.col("arrival"), days=1)
    stored, fresh = run()
    # Files arrive in the order they were written: ids under 100 first.
    mark, want = None, []
    for part in (rows[:100], rows[100:]):
        days = sorted({(r[2] - T0).days for r in part})
        for day in days:
            own = [r for r in part if (r[2] - T0).days == day]
            mark = max([r[1] for r in own] + ([mark] if mark else []))
            want += [r[0] for r in own if r[1] >= mark - timedelta(hours=24)]
    assert stored == list(range(200)) and fresh == sorted(want) and 0 < len(fresh) < 200
    # The last batch runs again, as after a driver that was lost before it noted the batch: nothing doubles.
    last = max(int(x) for x in os.listdir(tmp_path / "progress/commits") if x.isdigit())
    os.remove(tmp_path / f"progress/commits/{last}")
    shutil.rmtree(tmp_path / "progress/commits" / f".{last}.crc", ignore_errors=True)
    crc = tmp_path / f"progress/commits/.{last}.crc"
    if crc.exists():
        crc.unlink()
    assert run() == (stored, fresh)


def test_leases_expire_and_are_queued_again(spark, tmp_path):
    minute = lambda m: T0 + timedelta(minutes=m)
    claims = [(i, minute(i * 30), i % 4) for i in range(100)]
    results = [(i, minute(i * 30 + i % 25)) for i in range(100) if i % 3]
    c = spark.createDataFrame(claims, "item long, claimed_at timestamp_ntz, attempt int")
    r = spark.createDataFrame(results, "item long, result_at timestamp_ntz")
    paths = [f"file://{tmp_path}/{x}" for x in ("c", "r", "out", "progress")]

    def run():
        joined = leases.leased(feeds.files(spark, paths[0], c.schema, 1), feeds.files(spark, paths[1], r.schema, 1), ttl="10 minutes", late="1 minute")
        return feeds.drain(joined, paths[2], "append", paths[3])

    for part in ("item < 50", "item >= 50"):
        feeds.replay(c.where(part), paths[0], F.col("claimed_at"), days=1)
        feeds.replay(r.where(part), paths[1], F.col("result_at"), days=1)
        got = run()
    have = {x["item"]: x["status"] for x in got.collect()}
    mark = min(claims[-1][1], max(x[1] for x in results)) - timedelta(minutes=1)
    for i, at, _ in claims:
        want = "done" if i % 3 and i % 25 <= 10 else "expired" if at + timedelta(minutes=10) < mark else None
        assert have.get(i) == want, i
    again = {x["item"]: x["attempt"] for x in leases.queued_again(got).collect()}
    assert again == {i: i % 4 + 1 for i, s in have.items() if s == "expired" and i % 4 < 3} and again


def test_histograms_of_a_stream_are_those_of_its_rows(spark, tmp_path):
    d = spark.range(1_000).select("id", (F.col("id") % 37).cast("double").alias("v"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,id)").alias("at"))
    bounds = {"size": (1, 5.5, 36, 1_000)}
    feeds.replay(d, f"file://{tmp_path}/feed", F.col("at"), days=10)
    s = metrics.streamed(feeds.files(spark, f"file://{tmp_path}/feed", d.schema, 1), {"size": F.when(F.col("id") % 5 > 0, F.col("v"))}, bounds)
    q = s.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) > 3
    got = {(r["metric"], r["le"]): (r["n"], r["total"], r["largest"]) for r in metrics.rows(spark, metrics.total(q.recentProgress), bounds).collect()}
    vs = [float(i % 37) for i in range(1_000) if i % 5]
    assert got == {("size", float(b)): (sum(v <= b for v in vs), None, None) for b in bounds["size"]} | {("size", None): (len(vs), sum(vs), max(vs))}


@pytest.mark.parametrize("empty", [True, False])
def test_observed_counts_ride_on_an_action(spark, empty):
    d = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS v").where("v < 0" if empty else "true")
    seen, report = metrics.observed(d, {"size": F.col("v")}, {"size": (10, 50)})
    seen.write.format("noop").mode("overwrite").save()
    rows = [tuple(r) for r in metrics.rows(spark, report.get, {"size": (10, 50)}).collect()]
    assert rows == ([("size", 10.0, 0, None, None), ("size", 50.0, 0, None, None), ("size", None, 0, None, None)] if empty else [("size", 10.0, 11, None, None), ("size", 50.0, 51, None, None), ("size", None, 100, 4950.0, 99.0)])
