"""Row operators, windows and state on small inputs with known results."""

import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeflow.functions import bands
from tradeflow.operators import accumulation, baselines, detectors, flow, graphs, outcomes, scoring, state
from tradeflow.operators.asof import asof
from tradeflow.sources import trades
from tradeflow.sources import records

T0 = datetime(2024, 1, 1)
BASE = "notional double, price double, m_count int, m_total double, m_p95 double, m_p99 double, t_count int, t_p95 double, t_p99 double"


def scored(spark, rows, t=None):
    d = spark.createDataFrame([(*r,) for r in rows], BASE)
    return scoring.score(d, t or scoring.Thresholds.default()).collect()


@pytest.mark.parametrize(("median", "notional", "odds", "want"), [
    (100, 100_000, 8, "critical"), (100, 100_000, 3, "info"), (100, 25_000, 5, "warning"), (100, 10_000, 3, "info"), (100, 9_999, 3, None),
    (100, 10_000, 2.99, None), (60, 1_000_000, 3, "info"), (60, 300_000, 6, "warning"), (60, 700_000, 10, "critical")])
def test_tiers(spark, median, notional, odds, want):
    r = scored(spark, [(float(notional), 1 / odds, 30, 30.0 * median, float(median), float(median), 30, float(median), float(median))])[0]
    assert r["severity"] == want


def test_scorer_gates(spark):
    ready = (30, 3000.0, 20_000.0, 30_000.0)
    none = (0, 0.0, 0.0, 0.0)
    rows = [(50_000.0, 0.1, *ready, 30, 100_000.0, 1.0), (50_000.0, 0.1, *ready, 0, 0.0, 0.0), (150_000.0, 0.1, *none, 30, 50_000.0, 1.0), (50_000.0, 0.1, *none, 0, 0.0, 0.0),
            (150_000.0, 0.1, *none, 0, 0.0, 0.0), (5.0, 0.0, *ready, 0, 0.0, 0.0), (5.0, 1.0, *ready, 0, 0.0, 0.0), (-1.0, 0.5, *ready, 0, 0.0, 0.0)]
    got = scored(spark, rows)
    assert got[0]["reason"] == "below_trader_p95"  # one trader ratio is below
    assert got[1]["severity"] == "warning" and got[2]["severity"] == "critical" and not got[2]["capped"]
    assert got[3]["severity"] == "info" and got[3]["capped"]
    assert got[4]["severity"] == "critical"
    assert [r["reason"] for r in got[5:]] == ["invalid_input"] * 3


def test_missing_baselines_are_not_ready(spark):
    r = scored(spark, [(10_000.0, 0.2, None, None, None, None, None, None, None)])[0]
    assert r["severity"] == "info" and not r["m_ready"] and not r["t_ready"]


def test_distribution(spark):
    rows = [("m", "o", 100.0, T0 + timedelta(hours=i)) for i in range(19)] + [("m", "o", 1000.0, T0 + timedelta(hours=19))]
    d = spark.createDataFrame(rows, "market string, outcome string, notional double, traded_at timestamp_ntz")
    r = flow.distribution(d, ["market", "outcome"]).first()
    assert (r["n"], r["mean"], r["median"]) == (20, 145.0, 100.0) and abs(r["p95"] - 145) < 1e-9
    keys = spark.createDataFrame([("m", "o"), ("x", "y")], "market string, outcome string")
    got = {x["market"]: (x["n"], x["total"], x["oldest"]) for x in flow.distribution_of(keys, flow.distribution(d, ["market", "outcome"]), ["market", "outcome"]).collect()}
    assert got["x"] == (0, 0.0, None)


@pytest.mark.parametrize(("x", "want"), [(74.9, "0-75%"), (75.0, "75-80%"), (100.0, "95-100%"), (100.1, "unknown")])
def test_lifecycle_bands(spark, x, want):
    assert spark.range(1).select(bands.lifecycle_band(F.lit(x)).alias("b")).first()["b"] == want


def test_band_edges(spark):
    d = spark.createDataFrame([(0.0,), (500.0,), (1500.0,), (7000.0,), (1_000_000.0,), (1000.0,), (999.99,)], "x double")
    assert [r[0] for r in d.select(bands.notional_band("x")).collect()] == ["", "<1k", "1-5k", "5-10k", "500k+", "1-5k", "<1k"]


def test_ownership(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 0.5), (100_000.0, 0.0, 1_000_000.0, 0.5), (160_000.0, 10_000.0, 1_000_000.0, 0.5), (300_000.0, 0.0, 1_000_000.0, 0.5), (300_000.0, 250_000.0, 1_000_000.0, 0.5)], "wallet_buy double, wallet_sell double, market_buy double, price double")
    assert [r["severity"] for r in flow.ownership_verdict(d).collect()] == [None, "info", "warning", "critical", None]


def test_market_maker(spark):
    d = spark.createDataFrame([(5, 0, 10.0, 0.0), (3, 5, 10.0, 10.0), (5, 5, 10.0, 5.0), (5, 5, 10.0, 9.0)], "buy_n int, sell_n int, buy_usd double, sell_usd double")
    assert [r["suppress"] for r in flow.market_maker(d).collect()] == [False, False, False, True]


def test_quiet_market(spark):
    s = "n long, total double, span_h double, median double, last_at timestamp_ntz, at timestamp_ntz, notional double"
    at = T0 + timedelta(hours=24)
    rows = [(10, 1000.0, 240.0, 100.0, T0, at, 20_000.0), (1000, 1000.0, 24.0, 100.0, T0, at, 20_000.0), (10, 1000.0, 240.0, 100.0, T0, at, 500.0), (10, 1000.0, 240.0, 100.0, at - timedelta(hours=1), at, 20_000.0),
            (10, 1000.0, 240.0, 1000.0, T0, at, 20_000.0), (10, 1000.0, 240.0, 100.0, None, at, 20_000.0), (0, 0.0, 0.0, 0.0, None, at, 20_000.0)]
    assert [r["wakes"] for r in flow.quiet_wakeup(spark.createDataFrame(rows, s)).collect()] == [True, False, False, False, False, True, False]


def line(**k):
    r = {"n": 5, "total": 300_000.0, "median": 60_000.0, "largest": 60_000.0, "avg_odds": 8.0, "oldest": T0, "newest": T0 + timedelta(hours=4), "market_p95": 10_000.0, "trader_p95": 10_000.0, "lifecycle": 80.0, "hot": True} | k
    return tuple(r.values())


LINE = "n int, total double, median double, largest double, avg_odds double, oldest timestamp, newest timestamp, market_p95 double, trader_p95 double, lifecycle double, hot boolean"


def test_accumulation(spark):
    rows = [line(), line(hot=False), line(n=2), line(n=4), line(avg_odds=2.0), line(total=150_000.0, median=10_000.0, largest=10_000.0), line(market_p95=0.0, trader_p95=0.0), line(total=20_000.0, median=6_000.0, avg_odds=3.0, n=3)]
    got = accumulation.verdict(spark.createDataFrame(rows, LINE), scoring.Thresholds.default()).collect()
    assert [r["severity"] for r in got] == ["hard", "critical", None, "warning", None, "warning", "hard", "info"]
    assert got[0]["size_path"] == "meaningful" and got[5]["size_path"] == "many-smalls"
    assert abs(got[0]["confidence"] - 0.85) < 1e-9 and 0 <= got[0]["score"] <= 100
    assert "HOT_MARKET_ACCUMULATION" in got[0]["reasons"] and "LOW_BASELINE_CONFIDENCE" in got[6]["reasons"]


def test_holder_delta(spark):
    s = "rank int, prev_rank int, shares double, prev_shares double, pct_oi double, total_oi double, prev_total_oi double"
    rows = [(3, 9, 12_000.0, 4_000.0, 0.12, 100_000.0, 100_000.0), (3, 3, 4_000.0, 4_000.0, 0.12, 50_000.0, 100_000.0), (2, None, 500.0, None, 0.01, 100_000.0, None)]
    got = detectors.holder_delta(spark.createDataFrame(rows, s)).collect()
    assert [r["level"] for r in got] == ["warning", "none", "info"] and got[0]["penalty"] == 1.0 and got[1]["penalty"] == 0.5 and got[2]["entered_top"]


def test_conflict_and_lag(spark):
    d = spark.createDataFrame([(0.0, 0.0, False, False), (10.0, 2.0, False, False), (10.0, 6.0, False, False), (10.0, 9.0, False, False), (10.0, 9.0, True, False)], "score_a double, score_b double, mm_a boolean, mm_b boolean")
    assert [(r["action"].split("_")[-2], r["winner"]) for r in detectors.conflict(d).collect()] == [("keep", None), ("suppress", "A"), ("degrade", "A"), ("tag", None), ("degrade", "B")]
    lag = spark.createDataFrame([(0.0, 0.0, 9.0, 2, 0.1), (0.0, 6.0, 0.0, 0, 0.1), (9.0, 0.0, 6.0, 3, 0.1), (0.0, 0.0, 9.0, 1, 0.1), (0.0, 9.0, 9.0, 3, 0.8)], "observed double, expected double, peer_median double, n_peers int, ambiguity double")
    assert [(r["bias"], r["level"]) for r in detectors.repricing_lag(lag).collect()] == [("underreaction", "critical"), ("underreaction", "warning"), ("overreaction", "info"), (None, "none"), (None, "none")]


def test_rules_risk(spark):
    rows = [("Runoff recount appeal court ruling injunction certified by end of year announced official", "", ""), ("A plain question", "", ""), ("Court ruling on appeal", "per Reuters and the Associated Press", "")]
    got = detectors.rules_risk(spark.createDataFrame(rows, "title string, description string, rules string"), ["title", "description", "rules"]).collect()
    assert got[0]["action"] == "block_both" and got[1]["action"] == "allow" and got[1]["ambiguity"] == 0.0
    assert abs(got[2]["ambiguity"] - (0.10 + 0.10 + 0.15 + 0.10 - 0.05)) < 1e-9


def test_regime(spark):
    rows = [("UMA oracle dispute",), ("missile and troops",), ("election for the senate",), ("merger of a company",), ("weather",), (None,)]
    assert [r["regime"] for r in detectors.regime(spark.createDataFrame(rows, "t string"), ["t"]).collect()] == ["oracle_sensitive", "geopolitics_military", "politics_governance", "corporate_private_info", "other", "other"]


def test_catalyst_prefers_the_farther_upcoming_one(spark):
    s = spark.createDataFrame([(1, 1, T0)], "signal_id int, event_id int, at timestamp_ntz")
    c = spark.createDataFrame([(1, "a", T0 + timedelta(hours=2), 1.0, 24.0, 12.0), (1, "b", T0 + timedelta(hours=20), 0.5, 24.0, 12.0), (1, "c", T0 - timedelta(hours=1), 1.0, 24.0, 12.0), (1, "d", T0 + timedelta(hours=30), 1.0, 24.0, 12.0)],
                              "event_id int, kind string, expected_at timestamp_ntz, confidence double, pre_h double, post_h double")
    r = detectors.catalyst_window(s, c).first()
    assert r["kind"] == "b" and r["window_class"] == "pre_long" and abs(r["boost"] - 12 * 0.5 * (1 - 20 / 24)) < 1e-9
    assert detectors.catalyst_window(s, c.where("kind = 'c'")).first()["window_class"] == "post_short"


def test_co_trade_edges(spark):
    rows = [(w, e, "BUY") for w in (1, 2) for e in (1, 2, 3)] + [(3, e, "SELL") for e in (1, 2, 3)]
    got = graphs.co_trade_edges(spark.createDataFrame(rows, "trader_id int, event_id int, side string")).collect()
    assert [(r["wallet_a"], r["wallet_b"], r["shared"], r["similarity"]) for r in got] == [(1, 2, 3, 1.0)]


def test_thesis(spark):
    lines = spark.createDataFrame([(1, m, "BUY", u, 5000.0) for m, u in ((1, 25_000.0), (2, 30_000.0), (3, 20_000.0))], "trader_id int, market_id int, side string, usd double, median double")
    links = spark.createDataFrame([(1, 2, "aligned", 1.0), (1, 3, "aligned", 1.0)], "src int, dst int, direction string, confidence double")
    r = graphs.thesis_score(lines, links, floor=5_000).where("src = 1").first()
    assert r["breadth"] == 3 and r["consistency"] >= 0.99 and r["level"] != "none"
    bad = graphs.thesis_score(lines.where("market_id < 3"), links.where("dst = 2").withColumn("direction", F.lit("opposed")), floor=5_000).where("src = 1").first()
    assert bad["level"] == "none"


def test_asof_against_brute_force_with_ties(spark):
    r = random.Random(1)
    left = [(i, r.randrange(3), T0 + timedelta(days=r.randrange(0, 40) * 30)) for i in range(200)]
    right = [(r.randrange(3), T0 + timedelta(days=r.randrange(0, 40) * 30), float(r.randrange(5))) for _ in range(60)]
    ld, rd = spark.createDataFrame(left, "id int, k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, u timestamp_ntz, v double")
    for direction in ("backward", "forward"):
        for strict in (False, True):
            got = {x["id"]: x["v"] for x in asof(ld, rd, ["k"], "t", "u", ["v"], direction, strict).collect()}
            for i, k, t in left:
                ok = [(u, v) for kk, u, v in right if kk == k and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
                want = None
                if ok:
                    at = max(ok)[0] if direction == "backward" else min(ok)[0]
                    want = max(v for u, v in ok if u == at)
                assert got[i] == want, (direction, strict, i)


def test_forward_returns(spark):
    a = spark.createDataFrame([(1, "BUY", 0.5, T0), (1, "SELL", 0.5, T0), (2, "BUY", 0.5, T0)], "market int, side string, price double, sent timestamp_ntz")
    p = spark.createDataFrame([(1, T0 + timedelta(days=1), 0.6), (1, T0 + timedelta(days=4), 0.4)], "market int, at timestamp_ntz, price double")
    got = outcomes.forward_returns(a, p, ["market"], "sent", "at", {"ret_a": 1, "ret_b": 3, "ret_c": 9}).withColumn("s", outcomes.drift_status(["ret_a", "ret_b", "ret_c"])).orderBy("market", "side").collect()
    assert abs(got[0]["ret_a"] - 0.2) < 1e-9 and abs(got[1]["ret_a"] + 0.2) < 1e-9 and abs(got[0]["ret_b"] + 0.2) < 1e-9
    assert [r["s"] for r in got] == ["partial", "partial", "pending"]


def test_edges(spark):
    d = spark.createDataFrame([(0.08, "BUY", "correct", "hard"), (0.08, "SELL", "wrong", "info"), (0.5, "BUY", "unresolved", "none")], "price double, side string, outcome_status string, severity string")
    got = outcomes.with_edge(d).collect()
    assert abs(got[0]["edge"] - 0.92) < 1e-9 and got[0]["bucket"] == "0-10" and got[0]["weight"] == 25 and abs(got[1]["edge"] + 0.92) < 1e-9 and got[2]["edge"] is None


def cluster_rows(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(minutes=m), w, float(x)) for k, m, w, x in rows], "category int, at timestamp, wallet string, notional double")


def test_cluster_window(spark):
    rows = [(1, 0, "a", 500), (1, 10, "a", 500), (1, 20, "b", 1000), (1, 25, "b", 5000), (2, 0, "a", 900), (2, 1, "a", 900), (2, 2, "a", 900), (3, 0, "a", 900), (3, 100, "b", 900), (3, 200, "c", 900), (4, 0, "a", 1), (4, 1, "b", 1), (4, 2, "c", 1)]
    got = state.cluster_alerts(cluster_rows(spark, rows), "category").collect()
    assert [(r["key"], r["trades"], r["wallets"], r["total"]) for r in got] == [("1", 3, 2, 2000.0)]


def test_concentration_gate_against_a_plain_walk(spark):
    r = random.Random(5)
    rows = [(f"k{i}", r.randrange(4), r.randrange(6), float(r.randrange(1, 50)), T0 + timedelta(hours=r.random() * 300), r.choice(["info"] * 4 + ["warning"])) for i in range(400)]
    d = spark.createDataFrame(rows, "dedup_key string, event_id int, trader_id int, notional double, sent_at timestamp, severity string")
    got = {x["dedup_key"]: x["passes"] for x in state.concentration_gate(d).collect()}
    kept = []
    for k, e, w, n, at, sev in sorted(rows, key=lambda x: (x[1], x[4])):
        mine = [x for ke, kw, x, t in kept if ke == e and kw == w and t >= at - timedelta(hours=6)]
        every = [x for ke, _, x, t in kept if ke == e and t >= at - timedelta(hours=24)]
        ok = sev != "info" or (not (mine and n < 2 * max(mine)) and not (len(every) >= 3 and n < 2 * max(every)))
        assert got[k] == ok
        if ok:
            kept.append((e, w, n, at))


def test_concentration_gate_of_a_dense_event_takes_a_time_a_row(spark):
    """One event with 30,000 accepted alerts within its window: looking through them for each row would take minutes."""
    n = 60_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("dedup_key"), F.lit(1).alias("event_id"), (F.col("id") % 5_000).alias("trader_id"), F.when(F.col("id") % 2 == 0, 100.0).otherwise(150.0).alias("notional"),
                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("sent_at"), F.when(F.col("id") % 2 == 1, "info").otherwise("warning").alias("severity"))
    began = time.time()
    got = state.concentration_gate(rows, event_hours=24).groupBy("passes").count().collect()
    assert {r["passes"]: r["count"] for r in got} == {True: n // 2 + 1, False: n // 2 - 1}
    assert time.time() - began < 30


def test_concentration_gate_windows_end_apart(spark):
    """A wallet's window may be shorter or longer than the event's; a largest value that leaves it gives way to the next."""
    r = random.Random(8)
    rows = [(f"k{i}", 1, r.randrange(4), float(r.randrange(1, 60)), T0 + timedelta(hours=i * 0.7), r.choice(["info"] * 3 + ["warning"])) for i in range(300)]
    d = spark.createDataFrame(rows, "dedup_key string, event_id int, trader_id int, notional double, sent_at timestamp, severity string")
    for wh, eh in ((30, 5), (5, 30)):
        got = {x["dedup_key"]: x["passes"] for x in state.concentration_gate(d, wallet_hours=wh, event_hours=eh).collect()}
        kept = []
        for k, _, w, n, at, sev in rows:
            mine = [x for kw, x, t in kept if kw == w and t >= at - timedelta(hours=wh)]
            every = [x for _, x, t in kept if t >= at - timedelta(hours=eh)]
            ok = sev != "info" or (not (mine and n < 2 * max(mine)) and not (len(every) >= 3 and n < 2 * max(every)))
            assert got[k] == ok
            if ok:
                kept.append((w, n, at))


def test_baselines_before_repeat_no_row(spark):
    t = spark.createDataFrame([(1, T0 + timedelta(days=28 * (i % 20)), float(i)) for i in range(200)] + [(2, T0, None), (2, T0 + timedelta(days=40), 5.0), (2, T0 + timedelta(days=80), -1.0)], "k int, traded_at timestamp, notional double")
    d = baselines.before(t, ["k"])
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["k"], r["period"]): r for r in d.collect()}
    day = lambda i: (T0 + timedelta(days=28 * i) - datetime(1970, 1, 1)).days // 28
    for i in range(1, 20):
        values = sorted(float(x) for x in range(1, 200) if max(0, i - 13) <= x % 20 < i)
        r = got[(1, day(i))]
        place = (len(values) - 1) * 0.95
        assert r["n"] == len(values) and r["total"] == sum(values) and r["oldest"] == T0 + timedelta(days=28 * max(0, i - 13))
        assert r["p95"] == pytest.approx(values[math.floor(place)] + (values[math.ceil(place)] - values[math.floor(place)]) * (place - math.floor(place)))
    # A period whose own trades count for nothing still asks; one with nothing before it has no baseline.
    assert [k for k in got if k[0] == 2] == [(2, (T0 + timedelta(days=80) - datetime(1970, 1, 1)).days // 28)] and got[(2, (T0 + timedelta(days=80) - datetime(1970, 1, 1)).days // 28)]["n"] == 1


def test_baselines_before_send_rows_once_and_judge_some(spark):
    t = spark.createDataFrame([("m", i % 3, T0 + timedelta(days=20 * i), float(i + 1)) for i in range(40)], "market_id string, trader_id int, traded_at timestamp, notional double")
    assert baselines.before(t, ["market_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    every = {r["notional"]: tuple(r) for r in baselines.with_baselines(t, ["market_id"], ["trader_id"]).collect()}
    some = {r["notional"]: tuple(r) for r in baselines.with_baselines(t, ["market_id"], ["trader_id"], rows=t.where("notional > 30")).collect()}
    assert len(every) == 40 and some == {k: v for k, v in every.items() if k > 30}


def test_baselines_beside_are_those_of_a_join_and_send_rows_once(spark):
    """Null and other keys and times, values that never enter, repeated rows, rows that do not ask."""
    values = [None, -5.0, 0.0, float("nan"), 7.0, 7.0, 1e6]
    rows = [(None if i % 11 == 0 else f"m{i % 2}", i, None if i % 13 == 0 else T0 + timedelta(days=9 * (i // 2)), values[i % 7]) for i in range(120)]
    rows += [r for r in rows if r[1] % 5 == 0]
    t = spark.createDataFrame(rows, "market_id string, trader_id int, traded_at timestamp, notional double")
    d = t.withColumn("period", baselines.period("traded_at", 28))
    got = baselines.beside(d, ["market_id"], "m")
    want = baselines.with_baselines(t, ["market_id"], ["trader_id"]).select("market_id", baselines.period("traded_at", 28).alias("period"), "trader_id", "traded_at", "notional", "m_count", "m_total", "m_p95")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.where("m_count > 5").count()
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    some = baselines.beside(d, ["market_id"], "m", asks=F.col("trader_id") % 2 == 0)
    assert some.where("trader_id % 2 = 1 and m_count is not null").isEmpty() and some.where("trader_id % 2 = 0").exceptAll(got).isEmpty() and some.count() == len(rows)


def test_scored_before_sends_trades_thrice_and_writes_none(spark):
    """To their order, their wallet and their market; a wallet's and a market's baselines are not joined."""
    import __spark_entry__

    plan = __spark_entry__.queries()["scored_before"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and plan.count("RepartitionByExpression") == 2 and plan.count("lineitem") <= 1


def test_compact_is_without_loss(spark):
    """Values that do not fit, one at a time and in all pairs, come back as they were."""
    from tradeflow.functions import compact

    size = [(0.0, 1), (0.01, 1), (84197.04, 1), (0.1 + 0.2, 0), (-5.0, 0), (2e6, 0), (1e300, 0), (float("inf"), 0), (float("nan"), 0), (None, 0)]
    at = [(datetime(1996, 9, 13), 1), (datetime(1996, 9, 13, 0, 0, 0, 1), 0), (datetime(1969, 12, 31), 0), (datetime(9999, 12, 31), 0), (None, 0)]
    n = [(0, 1), (63, 1), (64, 0), (-1, 0), (None, 0)]
    rows = [(i, s, a, k, f, bool(g and h and m and f is not None)) for i, ((s, g), (a, h), (k, m), f) in enumerate((s, a, k, f) for s in size for a in at for k in n for f in (True, False, None))]
    for kind in ("timestamp_ntz", "timestamp"):
        d = spark.createDataFrame(rows, f"i int, s double, a {kind}, k int, f boolean, fits boolean")
        parts = {"s": compact.hundredths(F.col("s"), 27), "a": compact.day(F.col("a"), d.schema["a"].dataType), "k": compact.number(F.col("k"), 6, "int"), "f": compact.flag(F.col("f"))}
        p = d.select("i", "fits", *[c.alias(x) for x, c in compact.pack(**parts).items()])
        back = p.select("i", *[c.alias(x) for x, c in compact.unpack(parts).items()])
        assert sorted(map(str, back.collect())) == sorted(map(str, d.drop("fits").collect())) and [t for _, t in back.dtypes] == [t for c, t in d.dtypes if c != "fits"]
        assert p.where(F.col("word").isNull() != F.col("odd").isNotNull()).isEmpty() and (kind == "timestamp" or p.where(F.col("word").isNotNull() != F.col("fits")).isEmpty())
    with pytest.raises(ValueError):
        compact.pack(a=compact.number(F.col("k"), 40, "int"), b=compact.number(F.col("k"), 24, "int"))


def test_trades_are_not_sent_to_their_suppliers(spark, tmp_path):
    """Suppliers are too large to be broadcast by the product of their size and the nations', but not by their own."""
    for n in ("lineitem", "orders", "supplier", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    size = max(f.stat().st_size for n in ("orders", "supplier") for f in (tmp_path / f"{n}.parquet").glob("*.parquet"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        t = trades.Domain(spark, str(tmp_path))
        for d in (t.trades, t.narrow(**compact_of(t))):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(market_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def compact_of(t):
    from tradeflow.functions import compact

    return compact.pack(**t.parts)


def test_scored_before_sends_a_long_a_trade(spark):
    """Sizes, prices and periods go as one long; of a wallet's baseline its percentile alone goes on."""
    import __spark_entry__

    plan = __spark_entry__.queries()["scored_before"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    sent, todo = [], [plan]
    while todo:
        p = todo.pop()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if p.nodeName() == "RepartitionByExpression":
            sent.append({p.output().apply(i).name() for i in range(p.output().size())})
    assert sorted(map(sorted, sent)) == [["market_id", "odd", "outcome", "t_p95", "word"], ["market_id", "odd", "outcome", "trader_id", "word"]]


def test_wallet_age_sends_trades_once(spark):
    rows = [(1, T0, 1.0), (1, T0, 9e3)] + [(1, T0 + timedelta(days=40), x) for x in (9e3, 9e3, 1.0)] + [(1, T0 + timedelta(days=41), 9e3)] * 6 + [(2, T0 + timedelta(days=90), 9e3), (None, T0, 1.0)]
    d = flow.wallet_age(spark.createDataFrame(rows, "trader_id int, traded_at timestamp, notional double"))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [(r["trader_id"], (r["traded_at"] - T0).days, r["is_new"], r["dormant"]) for r in d.collect()]
    assert sorted(x for x in got if x[0] == 1) == sorted([(1, 0, True, False)] * 2 + [(1, 40, False, True)] * 2 + [(1, 40, False, False)] + [(1, 41, False, False)] * 6)
    assert (2, 90, True, False) in got


def test_only_trades_that_may_fire_need_baselines(spark):
    rules = scoring.Thresholds.for_driver()
    rows = [(n, p, 10, 1e5, b, b, 30, b, b) for n in (None, 0.0, 9_999.0, 10_000.0, 25_000.0, 400_000.0) for p in (None, 0.0, 0.05, 0.14, 0.3, 1 / 3, 0.6, 1.0) for b in (None, 1.0, 1e9)]
    d = scoring.score(spark.createDataFrame(rows, "notional double, price double, m_count int, m_total double, m_p95 double, m_p99 double, t_count int, t_p95 double, t_p99 double"), rules)
    got = d.select(F.col("severity").isNotNull().alias("fired"), scoring.may_fire(rules).alias("may")).collect()
    assert any(r["fired"] for r in got) and any(not r["may"] for r in got) and all(r["may"] for r in got if r["fired"])


def test_forward_returns_send_alerts_once(spark):
    """What is looked up for each horizon is the alerts' places and times; their other columns take no part."""
    a = spark.createDataFrame([("m", "BUY", 0.5, T0, "x" * 9, None)] * 2 + [(None, "BUY", 0.5, T0, "y", 1)], "market string, side string, price double, sent timestamp, wide string, nothing int")
    p = spark.createDataFrame([("m", T0 + timedelta(days=2), 0.75)], "market string, at timestamp, price double")
    d = outcomes.forward_returns(a, p, ["market"], "sent", "at", {"ret_a": 1, "ret_b": 3})
    assert sorted((r["wide"], r["ret_a"], r["ret_b"]) for r in d.collect()) == [("x" * 9, 0.5, None), ("x" * 9, 0.5, None), ("y", None, None)]
    grouped = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert grouped and not any("wide" in x for x in grouped)


def test_asof_of_unique_prices_groups_none(spark):
    a = spark.createDataFrame([(i, i % 3, T0 + timedelta(days=i * 37)) for i in range(60)], "id int, k int, t timestamp_ntz")
    p = spark.createDataFrame([(k, T0 + timedelta(days=i * 91 + k), None if i == 7 else float(i)) for k in range(2) for i in range(30)], "k int, u timestamp_ntz, v double")
    for direction in ("backward", "forward"):
        plain, unique = (asof(a, p, ["k"], "t", "u", ["v"], direction, unique=u) for u in (False, True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, unique.collect())) and any(r["v"] is None for r in plain.where("k < 2").collect())
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (plain, unique)]
        assert "SortAggregate" not in plans[0] + plans[1] and plans[1].count("HashAggregate") < plans[0].count("HashAggregate")


def test_decisions_without_returns_look_up_no_price(spark):
    """What asks for no return, or for one horizon, does not work out all four; alerts are grouped where their wallets are."""
    t = trades.Domain(spark, "/root/testdata/sf0.001")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(t.unmeasured) and "SortAggregate" not in plan(t.unmeasured)
    rows = lambda d: sorted(map(str, d.select("dedup_key", "strategy", "level", "linked_key", "created_at", "control_bucket").collect()))
    assert rows(t.unmeasured) == rows(t.decisions) == rows(t.once)
    some, every = (sorted(map(str, d.select("dedup_key", "ret_6h", "clv_6h").collect())) for d in (t.returns("ret_6h"), t.measured))
    assert some == every and "ret_1h" not in t.returns("ret_6h").columns


def test_upsert_is_idempotent(spark):
    h = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "x", 7)], "k int, at int, v string, m int")
    b = spark.createDataFrame([(1, 2, "", 3), (1, 3, None, 9), (3, 1, "n", 1)], "k int, at int, v string, m int")
    rules = {"at": "max", "v": "filled", "m": "max"}
    once = state.upsert(h, b, ["k"], "at", rules)
    assert {tuple(r) for r in once.collect()} == {(1, 3, "a", 9), (2, 1, "x", 7), (3, 1, "n", 1)}
    assert {tuple(r) for r in state.upsert(once, b, ["k"], "at", rules).collect()} == {tuple(r) for r in once.collect()}
    assert state.new_rows(b, once, ["k"], [F.col("at")]).count() == 0


def test_fingerprint(spark):
    rows = [(1, "b ", 1), (1, "A", 2), (2, "a", 2), (2, "B", 1), (3, "a", 2), (3, "c", 1), (4, "a", 2), (4, "b", 1), (4, "b", 1)]
    got = {r["k"]: r["fingerprint"] for r in state.fingerprint(spark.createDataFrame(rows, "k int, t string, n int"), ["k"], ["t", "n"]).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3


def test_feed_events(spark):
    book = '{"event_type":"book","asset_id":"a","bids":[{"price":".48","size":"1"},{"price":".50","size":"1"}],"asks":[{"price":".54","size":"1"},{"price":".52","size":"2"}],"timestamp":"1700000000000"}'
    d = spark.createDataFrame([(book,), ('{"event_type":"best_bid_ask","best_bid":"0.1","best_ask":"0.3","timestamp":"1700000000"}',), ("not json",), (None,)], "value string")
    got = records.feed_events(d).collect()
    assert (got[0]["bid"], got[0]["ask"]) == (0.5, 0.52) and abs(got[0]["mid"] - 0.51) < 1e-9 and got[0]["at"] == got[1]["at"] and got[2]["event_type"] is None and len(got) == 4


def test_event_page(spark):
    page = '{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["e"],"state":{"data":{"markets":[{"conditionId":"c","question":"q","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"0.995\\",\\"0.005\\"]","clobTokenIds":"bad"}]}}}]}}}'
    r = records.event_markets(spark.createDataFrame([(page,)], "value string")).first()
    assert r["outcomes"] == ["Yes", "No"] and r["prices"] == [0.995, 0.005] and r["tokens"] == []
    d = spark.createDataFrame([(r["outcomes"], r["prices"])], "o array<string>, p array<double>")
    assert d.select(outcomes.winner("o", "p").alias("w")).first()["w"] == "Yes"


def test_lenient_values(spark):
    d = spark.createDataFrame([("1.5",), (" 2 ",), ("x",), (None,)], "v string")
    assert [r[0] for r in d.select(records.lenient_number(F.col("v"))).collect()] == [1.5, 2.0, None, None]
    b = spark.createDataFrame([("true",), ("0",), ("Yes",), ("",), ("?",)], "v string")
    assert [r[0] for r in b.select(records.lenient_bool(F.col("v"))).collect()] == [True, False, True, False, None]


def test_outcome_mapping(spark):
    d = spark.createDataFrame([("Yes",), ("YES",), ("Team A",), ("?",), (None,)], "label string")
    got = records.mapped_outcome(d, ["Yes", "No"], {"Team A": "No"}).collect()
    assert [(r["outcome"], r["confidence"]) for r in got] == [("Yes", 1.0), ("Yes", 0.85), ("No", 0.7), (None, 0.0), (None, 0.0)]


def test_category_gates(spark):
    d = spark.createDataFrame([("Politics", "x"), ("Sports", "us-politics"), ("", "politics"), (None, None)], "label string, slug string")
    assert [r[0] for r in d.select(scoring.allowed_category(F.col("label"), F.col("slug"), ["POLIT"])).collect()] == [True, True, False, False]
    assert d.select(scoring.allowed_category(F.col("label"), F.col("slug"), []).alias("a")).distinct().first()["a"] is True


def test_promotion_eligibility(spark):
    d = spark.createDataFrame([(50, 1.0, 0.1, 5.0), (5, 1.0, 0.1, 5.0), (50, 1.0, 0.9, 5.0), (50, None, None, 5.0)], "n int, median double, reversal double, per_day double")
    assert [r[0] for r in d.select(outcomes.eligible()).collect()] == [True, False, False, False]


def test_co_trade_counts_every_event(spark):
    """An event of a thousand wallets, cut into blocks, gives all its pairs."""
    from tradeflow.operators import graphs

    rows = [("BUY", 1, w) for w in range(1000)] + [("BUY", 2, w) for w in range(0, 1000, 100)] + [("BUY", 3, 5000), ("SELL", 1, 0), (None, 1, None)]
    t = spark.createDataFrame(rows, "side string, event_id int, trader_id int")
    got = {(r["wallet_a"], r["wallet_b"]): (r["shared"], r["similarity"]) for r in graphs.co_trade_edges(t, min_shared=2).collect()}
    assert got == {(a, b): (2, 1.0) for a in range(0, 1000, 100) for b in range(a + 100, 1000, 100)}
    assert graphs.co_trade_edges(t.where("event_id = 1"), min_shared=1, block=90).where("side = 'BUY'").count() == 1000 * 999 // 2


def test_appending_a_batch_twice(spark, tmp_path):
    from tradeflow.sources import sink

    path = str(tmp_path / "t")
    for batch, rows in (("a", [1, 2]), ("b", [3]), ("a", [1, 2])):
        sink.append(spark.createDataFrame([(x,) for x in rows], "id int"), path, batch)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_peer_medians_against_brute_force(spark):
    from statistics import median

    rng = random.Random(3)
    rows = [(i, g, rng.choice([None, 1.0, 2.0, 2.0, rng.random()])) for g in range(1, 60) for i in range(100 * g, 100 * g + g % 9 + 1)] + [(1, None, 1.0)]
    got = {r["m"]: (r["n_peers"], r["peer_median"]) for r in detectors.peer_medians(spark.createDataFrame(rows, "m int, g int, v double"), "g", "v").collect()}
    want = {}
    for m, g, _ in rows[:-1]:
        peers = [v for n, h, v in rows if h == g and n != m]
        known = [v for v in peers if v is not None]
        want[m] = (len(peers), median(known) if known else None)
    assert got == want


def test_baselines_before_ignore_the_present_and_the_future(spark):
    from tradeflow.operators import baselines

    rows = [("m", f"2000-{1 + i // 28:02d}-{1 + i % 28:02d} 00:00:00", float(i + 1)) for i in range(112)]
    make = lambda r: spark.createDataFrame(r, "market_id string, at string, notional double").withColumn("traded_at", F.to_timestamp_ntz("at"))
    past = {r.period: r for r in baselines.before(make(rows), ["market_id"], periods=2).collect()}
    later = {r.period: r for r in baselines.before(make(rows + [("m", "2000-12-01 00:00:00", 1e9)]), ["market_id"], periods=2).collect()}
    assert past and all(later[p] == r for p, r in past.items())
    start = {p: min(v) for p, v in _by_period(rows).items()}
    for p, r in past.items():
        want = [v for q, vs in _by_period(rows).items() if p - 2 <= q < p for v in vs]
        assert r.n == len(want) and r.total == sum(want) and max(want) < start[p]
    one = baselines.with_baselines(make(rows[:1]).withColumn("trader_id", F.lit(1)), ["market_id"], ["trader_id"]).first()
    assert one.m_count is None and one.t_count is None


def _by_period(rows):
    from collections import defaultdict
    from datetime import datetime

    out = defaultdict(list)
    for _, at, v in rows:
        out[(datetime.fromisoformat(at) - datetime(1970, 1, 1)).days // 28].append(v)
    return out


def test_events_due_by_tier(spark):
    from tradeflow.operators import detectors

    d = spark.createDataFrame([(1, 10, "Elections", 0.0, 0, 6), (2, 20, "sports", 20_000.0, 0, 6), (3, 30, "sports", 5.0, 0, None), (4, 40, None, 5.0, 4, 5), (4, 41, None, 9.0, 0, 5), (5, 50, "sports", 5.0, 1, 15)],
                              "event_id int, market_id int, category string, volume double, alerts int, ago int")
    now = F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))
    got = detectors.due_events(d.withColumn("fetched_at", now - F.make_dt_interval(mins="ago")), now, categories=("elections",))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 1), (3, 30, 3), (4, 40, 1), (5, 50, 2)]


def test_thesis_boosts(spark):
    stamp = lambda c: F.to_timestamp_ntz(F.col(c))
    m = spark.createDataFrame([(1, 7, "2024-01-01", "2024-03-01"), (2, 7, "2023-01-01", "2024-01-30"), (3, 8, "2024-01-31", "2024-03-01")], "market_id int, event_id int, s string, e string")
    m = m.select("market_id", "event_id", stamp("s").alias("start_at"), stamp("e").alias("end_at"))
    links = spark.createDataFrame([(1, 2, "opposed", 1.0)], "src int, dst int, direction string, confidence double")
    c = spark.createDataFrame([(7, "2024-02-15", 0.8), (7, "2024-02-01", 0.4), (7, "2024-01-30", 1.0), (8, "2024-05-01", 1.0)], "event_id int, s string, confidence double").withColumn("expected_at", stamp("s"))
    boosts = graphs.thesis_boosts(m, links, c, F.to_timestamp_ntz(F.lit("2024-01-31")))
    got = {r.src: (round(r.catalyst_boost, 6), round(r.life_boost, 6)) for r in boosts.collect()}
    assert got == {1: (4.0, 5.0), 2: (4.0, 5.0), 3: (0.0, 0.0)}  # market 1 is late through the market it is linked to
    lines = spark.createDataFrame([(5, 1, "BUY", 9_000.0, 0.0), (5, 2, "BUY", 9_000.0, 0.0)], "trader_id int, market_id int, side string, usd double, median double")
    r = graphs.thesis_score(lines, links, boosts).where("src = 1").first()
    x = math.log1p(9)
    assert r.breadth == 1 and r.score == pytest.approx((0.5 * math.sqrt(x) + 9) / (1 + 0.5 * x))


def test_fresh_wallet_burst(spark):
    stamp = lambda d, c: d.withColumn(c, F.to_timestamp_ntz(c))
    alerts = stamp(spark.createDataFrame([("a", 1, 10, "BUY", "2024-01-10 12:00:00"), ("b", 2, 20, "BUY", "2024-01-10 12:00:00")], "dedup_key string, market_id int, trader_id int, side string, sent_at string"), "sent_at")
    old, new = "2023-12-01 00:00:00", "2024-01-10 06:00:00"
    rows = [(1, w, "BUY", new) for w in (10, 11, 12)] + [(1, 13, "SELL", new), (9, 14, "BUY", old), (1, 14, "BUY", new), (1, 15, "BUY", "2024-01-10 18:00:00"), (2, 20, "BUY", new), (2, 21, "BUY", new), (2, 21, "BUY", new)]
    entries = stamp(spark.createDataFrame(rows, "market_id int, trader_id int, side string, traded_at string"), "traded_at")
    none = spark.createDataFrame([], "side string, wallet_a int, wallet_b int, shared long, similarity double")
    assert [tuple(r) for r in graphs.cohorts(alerts, none, entries).collect()] == [("a", "fresh_wallet_burst", 3, None, 1.0)]
    peers = spark.createDataFrame([("BUY", 10, 14, 5, 0.9)], none.schema)
    assert [(r.branch, r.cohort_size, r.boost) for r in graphs.cohorts(alerts, peers, entries).collect()] == [("edge_density", 2, pytest.approx(1.8))]


def test_resolved_outcomes(spark):
    m = spark.createDataFrame([("c1", "e", "Team A", ["Yes", "No"], ["t1", "t2"]), ("c2", "e", "Team B", ["Yes", "No"], ["t3", None]), ("c0", "f", "Team B", ["Up"], [""]), ("c3", None, None, None, None)],
                              "condition_id string, event_id string, title string, outcomes array<string>, tokens array<string>")
    rows = [(1, "c1", "No", None, ("c1", 1, "No", 1.0, "exact_label")), (2, "c1", " yes ", "", ("c1", 0, "Yes", 0.85, "case_insensitive_label")), (3, "c1", "team a", "gone", ("c1", 0, "Yes", 0.7, "group_item_title")),
            (4, "c1", "Team B", None, ("c2", 0, "Yes", 0.7, "group_item_title")), (5, "c1", None, None, ("c1", 0, "Yes", 0.6, "binary_default")), (6, "c9", "No", None, (None, None, None, 0.0, "unknown_condition_id")),
            (7, "c1", "Team C", None, (None, None, None, 0.0, "label_not_found")), (8, "c9", "No", "t2", ("c1", 1, "No", 1.0, "token_match")), (9, "c3", "x", None, (None, None, None, 0.0, "unknown_condition_id")),
            (10, None, None, None, (None, None, None, 0.0, "unknown_condition_id"))]
    asked = spark.createDataFrame([r[:4] for r in rows], "id int, condition_id string, label string, token string")
    got = {r.id: (r.condition_id, r.outcome_index, r.outcome or None, r.confidence, r.reason) for r in records.resolved_outcomes(asked, m).collect()}
    assert got == {r[0]: r[4] for r in rows}
