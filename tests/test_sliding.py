"""Sliding operators against plain walks."""

import random
from datetime import datetime, timedelta

import pytest

from tradeflow.operators import reservoir

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(("samples", "stretch", "window"), [(5, 8, None), (5, 5, 2.0), (40, 64, 0.5), (1, 3, None)])
def test_reservoir_before(spark, samples, stretch, window):
    """A key's stretches meet its reservoir whole, on a hot key, ties, rows that never enter and old rows."""
    rng = random.Random(samples)
    rows = []
    for n, key in ((300, "hot"), (7, "a"), (1, None)):
        at = 0
        for i in range(n):
            at += rng.choice([0, 0, 3_600, 7_200, 90_000])
            rows.append((key, T0 + timedelta(seconds=at), i, rng.choice([None, -1.0, 0.0, float("nan"), 1.0, 2.0, 2.0, 5.5, 100.0, 1e6])))
    d = spark.createDataFrame(rows, "k string, traded_at timestamp_ntz, i int, notional double").repartition(4)
    got = reservoir.before(d, ["k"], ["traded_at", "i"], samples=samples, stretch=stretch, window_days=window, bucket_days=1)
    assert got.columns == ["k", "traded_at", "i", "notional", "n", "total", "p50", "p95", "p99", "oldest", "newest"]
    for key in ("hot", "a", None):
        own = [r for r in rows if r[0] == key]
        want = reservoir.brute([((r[1] - T0).total_seconds(), r[3]) for r in own], samples, window and window * 86_400)
        have = sorted((r for r in got.collect() if r["k"] == key), key=lambda r: r["i"])
        for r, (n, total, *q) in zip(have, want, strict=True):
            assert (r["n"], [r["p50"], r["p95"], r["p99"]]) == (n, q) and abs(r["total"] - total) < 1e-6
            assert (r["oldest"] is None) == (n == 0) and (n == 0 or T0 <= r["oldest"] <= r["newest"] <= r["traded_at"])


def test_reservoir_sends_small_keys_once(spark):
    """Only rows of keys larger than a stretch are numbered; those of others, of no key too, go to it as they are."""
    rows = [(None if i % 5 == 0 else "a" if i % 5 == 1 else "b", i, T0 + timedelta(days=i // 3), float(i % 17)) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, i int, traded_at timestamp, notional double")
    out = reservoir.before(d, ["k"], ["traded_at", "i"], samples=7, stretch=500, window_days=30)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    cut = reservoir.before(d, ["k"], ["traded_at", "i"], samples=7, stretch=50, window_days=30, bucket_days=9)
    assert sorted(map(str, out.collect())) == sorted(map(str, cut.collect())) and out.count() == 200


def test_reservoir_of_an_empty_table(spark):
    d = spark.createDataFrame([], "k string, traded_at timestamp_ntz, i int, notional double")
    assert reservoir.before(d, ["k"], ["traded_at", "i"]).count() == 0
    with pytest.raises(ValueError):
        reservoir.before(d, ["k"], ["traded_at"], samples=10, stretch=5)


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
def test_percentiles_by_selection(spark, limit):
    """The values of F.percentile, whatever is gathered at the end: hot groups, ties, both signs, values of any size."""
    from pyspark.sql import functions as F

    from tradeflow.operators.selection import percentiles

    rng = random.Random(limit)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randint(-12, 12)) for _ in range(700)] + [("hot", 5.0)] * 300 + [("one", 2.5)] * 40 + [("neg", -(10.0 ** (i % 9))) for i in range(60)] + [(None, 1.0), (None, 2.0), ("none", None), ("zero", 0.0), ("zero", -0.5), ("zero", 0.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    qs = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    want = {r["k"]: r["q"] for r in d.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("q")).collect() if r["q"]}
    got = {r["k"]: (r["n"], r["q"]) for r in percentiles(d, ["k"], "v", qs, limit).collect()}
    assert set(got) == set(want) == {"hot", "one", "neg", None, "zero"} and got["hot"][0] == 1_000
    for k, (_, q) in got.items():
        assert q == pytest.approx(want[k], rel=1e-12, abs=1e-300)
    r = percentiles(d, [], "v", (0.5,), limit).collect()
    assert len(r) == 1 and r[0]["q"][0] == pytest.approx(d.agg(F.percentile("v", F.lit(0.5))).first()[0])
    assert percentiles(d.where("false"), ["k"], "v", qs, limit).count() == 0 and percentiles(d.where("false"), [], "v", qs, limit).count() == 0


def plain_gate(rows, cooldown):
    """rows: (key, at, id, code), walked."""
    last, out = {}, {}
    for k, at, i, c in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last:
            why = "no_prior_semantic"
        elif last[k][0] != c:
            why = "semantic_changed"
        else:
            why = "cooldown_elapsed" if at - last[k][1] >= cooldown else "cooldown_active"
        if why != "cooldown_active":
            last[k] = (c, at)
        out[i] = (why != "cooldown_active", why)
    return out


@pytest.mark.parametrize("codes", ["a", "aaaaab", "abc"])
def test_semantic_gate_is_a_plain_walk(spark, codes):
    """A hot key of one code is one run; pauses, ties in time and null codes occur."""
    from tradeflow.operators import islands

    rng = random.Random(len(codes))
    rows, at = [], T0
    for i in range(400):
        at += timedelta(seconds=rng.choice([0, 0, 60, 600, 1_000, 3_000]))
        rows.append(("hot" if i % 9 else f"k{i % 4}", at, i, rng.choice([*codes, None] if len(codes) == 3 else codes)))
    d = spark.createDataFrame(rows, "k string, at timestamp_ntz, id int, code string").repartition(5)
    got = {r["id"]: (r["allowed"], r["reason"]) for r in islands.semantic_gate(d, "k", "at", "code", ["id"], 2_500, bucket_days=1).collect()}
    assert got == plain_gate(rows, timedelta(seconds=2_500))


def test_quiet_cut_and_walks_side_by_side(spark):
    from tradeflow.operators import islands, state

    rng = random.Random(4)
    rows, at = [], T0
    for i in range(300):
        at += timedelta(minutes=rng.choice([1, 5, 20, 40, 200, 3_000]))
        rows.append(("hot" if i % 5 else None, at, rng.choice("abcd"), float(rng.randrange(100, 900))))
    d = spark.createDataFrame(rows, "category string, at timestamp, wallet string, notional double")
    cut = islands.quiet_cut(d, "category", "at", "60 MINUTES", bucket_days=1)
    for key in ("hot", None):
        own = sorted(r[1] for r in rows if r[0] == key)
        want = {}
        for i, x in enumerate(own):
            want[x] = x if i == 0 or x - own[i - 1] > timedelta(minutes=60) else want[own[i - 1]]
        assert {r["at"]: r["_island"]["at"] for r in cut.collect() if r["category"] == key} == want
        assert len(set(want.values())) > 3
    # Alerts as one walk of each key gives them, with the oldest rows of the window.
    got = sorted((r["key"] or "", r["at"], r["trades"], r["wallets"], r["total"], tuple(r["sample"])) for r in state.cluster_alerts(d, "category", hours=1, cooldown_hours=0.5, sample=2).collect())
    want = []
    for key in ("hot", None):
        window, quiet = [], None
        for _, x, w, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3])):
            window = [y for y in window if y[0] >= x - timedelta(hours=1)] + [(x, w, v)]
            if quiet and x < quiet:
                continue
            if len(window) >= 3 and len({y[1] for y in window}) >= 2 and sum(y[2] for y in window) >= 1_000:
                want.append((key or "", x, len(window), len({y[1] for y in window}), sum(y[2] for y in window), tuple(f"{y[1]}={y[2]:.2f}" for y in window[:2])))
                quiet = x + timedelta(minutes=30)
    assert got == sorted(want) and len(want) > 5


@pytest.mark.parametrize(("width", "seconds"), [(1, 60), (7, 60), (30, 3_600)])
def test_windows_over_panes(spark, width, seconds):
    import statistics

    from tradeflow.operators import panes

    rng = random.Random(width)
    rows, at = [], datetime(1970, 1, 1) + timedelta(days=19_000)
    for i in range(500):
        at += timedelta(seconds=rng.choice([0, 1, 30, 59, 400, 4_000]))
        rows.append((None if i % 11 == 0 else "hot", at, rng.choice([None, 1.0, 2.0, 2.0, 7.5, -3.0])))
    d = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double")
    got = panes.windows(panes.panes(d, ["k"], "at", "v", seconds), ["k"], width, seconds).collect()
    number = lambda x: int((x - datetime(1970, 1, 1)).total_seconds()) // seconds
    ends = {(k, number(x)) for k, x, v in rows if v is not None}
    assert len(got) == len(ends)
    for r in got:
        end = number(r["end_at"]) - 1
        own = [v for k, x, v in rows if k == r["k"] and v is not None and end - width < number(x) <= end]
        assert (r["n"], r["low"], r["high"], r["median"]) == (len(own), min(own), max(own), statistics.median(own)) and abs(r["total"] - sum(own)) < 1e-9
        assert r["panes"] == len({number(x) for k, x, v in rows if k == r["k"] and v is not None and end - width < number(x) <= end})
    assert panes.windows(panes.panes(d.where("false"), ["k"], "at", "v", seconds), ["k"], width, seconds).count() == 0


def test_sorted_blocks():
    from tradeflow.operators.panes import Sorted

    rng, s, plain = random.Random(0), Sorted(block=4), []
    for _ in range(3_000):
        if plain and rng.random() < 0.48:
            v = rng.choice(plain)
            plain.remove(v)
            s.drop(v)
        else:
            v = float(rng.randrange(40))
            plain.append(v)
            s.add(v)
        assert s.size == len(plain)
        if plain:
            assert s[0] == min(plain) and s[len(plain) - 1] == max(plain) and s[len(plain) // 2] == sorted(plain)[len(plain) // 2]


def test_staged_inputs(spark):
    from pyspark.sql import functions as F

    from tradeflow.operators import staged

    day = lambda n: T0 + timedelta(days=n)
    loads = spark.createDataFrame([("m", day(1), f"w{i}", i) for i in range(9)] + [("m", day(10), "x", 1), ("n", day(3), "y", 1)], "k string, loaded timestamp_ntz, w string, s int")
    asks = spark.createDataFrame([(1, "m", day(0)), (2, "m", day(1)), (3, "m", day(6)), (4, "m", day(7)), (5, "m", day(10)), (6, "n", day(2)), (7, "z", day(9)), (8, None, day(9))], "id int, k string, at timestamp_ntz")
    got = {r["id"]: (r["state"], r["rows"] and [x["w"] for x in r["rows"]]) for r in staged.staged(asks, loads, ["k"], "at", "loaded", ["w", "s"], [F.desc("s")], "5 DAYS", 3).collect()}
    assert got == {1: ("missing", None), 2: ("fresh", ["w8", "w7", "w6"]), 3: ("fresh", ["w8", "w7", "w6"]), 4: ("stale", None), 5: ("fresh", ["x"]), 6: ("missing", None), 7: ("missing", None), 8: ("missing", None)}


def test_selector(spark):
    from tradeflow.operators import selector

    assert [r[0] for r in selector.pins(spark, [" a", "", "a ", "b"]).collect()] == ["a", "b"] and selector.pins(spark, []).count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "condition_id string, rank_by long")
    chosen = selector.bucketed([(1, rows(("a", 0)), None), (2, rows(("b", 5), ("c", 5), ("d", 9), ("b", 1)), 2), (3, rows(("a", 9), ("e", 1)), 1)])
    assert {tuple(r) for r in chosen.collect()} == {("a", 1), ("d", 2), ("b", 2)}
    assert {r[0] for r in selector.bucketed([(2, rows(("b", 1), ("c", 1)), None), (1, rows(("z", 1)), None)], most=2).collect()} == {"z", "b"}
    pages = spark.createDataFrame([("a", 1, T0, True, '["t1","t2"]', '["Yes"]'), ("a", 1, T0 - timedelta(days=1), True, '["old"]', "[]"), ("b", 1, T0, False, '["t3"]', '["No"]'), ("d", 2, T0, True, None, None), ("e", 2, T0, True, "not json", '["x"]')], "condition_id string, event_id int, created_at timestamp_ntz, active boolean, tokens string, outcomes string")
    got = selector.subscriptions(chosen, selector.tokens(pages)).collect()
    assert sorted((r["condition_id"], r["token"], r["ordinal"], r["outcome"], r["bucket"], r["bucket_markets"]) for r in got) == [("a", "t1", 0, "Yes", 1, 1), ("a", "t2", 1, "", 1, 1)]


@pytest.mark.parametrize("stretch", [4, 7, 1_000])
def test_book_vacuum_in_stretches(spark, stretch):
    """A key cut into stretches gives the rows of the key taken whole: a hot key, a short one, one without a name, null depths."""
    from tradeflow.operators import detectors

    rng = random.Random(stretch)
    rows = []
    for n, key in ((400, "hot"), (3, "short"), (30, None)):
        for i in range(n):
            depth = lambda: rng.choice([None, 0.0, 10.0, 20.0, 30.0, 100.0])
            rows.append((key, T0 + timedelta(hours=5 * i), depth(), depth(), rng.choice([0.4, 0.5, 0.6]), rng.choice([0.01, 0.02, 0.05])))
    d = spark.createDataFrame(rows, "asset string, bar_at timestamp_ntz, ask_depth double, bid_depth double, mid double, spread double").repartition(4)
    cut = detectors.book_vacuum(d, window=4, stretch=stretch)
    whole = detectors.book_vacuum(d, window=4, bucket_days=None)
    assert cut.columns == whole.columns
    rounded = lambda x: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.collect())
    assert rounded(cut) == rounded(whole) and 50 < whole.count() < 433
    assert detectors.book_vacuum(d.limit(0)).count() == 0


def test_reservoir_sends_what_it_was_given(spark):
    """Nothing worked out for the walk goes on the way, and rows counted elsewhere are walked once, large keys or not."""
    from pyspark.sql import functions as F

    rows = [("a" if i % 3 else "b", i, T0 + timedelta(days=i // 3), float(i % 17)) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, i int, traded_at timestamp, notional double")
    for stretch in (500, 150, 50):
        read = spark.sparkContext.accumulator(0)
        t = d.mapInArrow(lambda it, read=read: (read.add(b.num_rows) or b for b in it), d.schema)
        out = reservoir.before(t, ["k"], ["traded_at", "i"], samples=7, stretch=stretch, window_days=30, bucket_days=9, counted=d)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        if stretch == 500:
            below = plan[plan.index("RepartitionByExpression"):]
            assert "unix_micros" in plan and "unix_micros" not in below and "isnan" not in below
        got = sorted(map(str, out.collect()))
        assert read.value == 300
        want = reservoir.before(d, ["k"], ["traded_at", "i"], samples=7, window_days=30).orderBy(F.col("i").cast("string")).collect()
        assert got == sorted(map(str, want))


def test_reservoir_opens_what_arrives(spark):
    """Columns packed on the way give what plain ones do, of large keys and of small ones, and are not sent."""
    from pyspark.sql import functions as F

    from tradeflow.functions import compact

    rows = [("a" if i % 3 else "b", i % 40, T0 + timedelta(days=i // 3, seconds=i % 2), [None, float("nan"), -1.0, 0.125, 2.5, 84197.04][i % 6]) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, i int, traded_at timestamp_ntz, notional double")
    parts = {"i": compact.number(F.col("i"), 5, "int"), "traded_at": compact.day(F.col("traded_at"), d.schema["traded_at"].dataType), "notional": compact.hundredths(F.col("notional"), 27)}
    t, found = d.select("k", *[c.alias(n) for n, c in compact.pack(**parts).items()]), compact.unpack(parts)
    assert not t.where("word is null").isEmpty() and not t.where("odd is null").isEmpty()
    asked = ["k", "i", "n", "total", "p50", "p99", "oldest", "newest"]
    for stretch in (500, 150, 50):
        given = {"samples": 7, "stretch": stretch, "window_days": 30, "bucket_days": 9}
        out = reservoir.before(t, ["k"], ["traded_at", "i", "notional"], opened=found, **given)
        assert out.columns[:3] == ["k", "word", "odd"]
        want = reservoir.before(d, ["k"], ["traded_at", "i", "notional"], **given).select(*asked)
        assert sorted(map(str, out.withColumns(found).select(*asked).collect())) == sorted(map(str, want.collect()))


def test_scored_reservoir_sends_a_long_a_trade(spark, monkeypatch):
    """Wallets come first, so markets are sent no wallet, and what a reservoir was read from is one long beside the order."""
    from tradeflow.plans import registry

    sent, plain = [], reservoir._small
    monkeypatch.setattr(reservoir, "_small", lambda d, *given: sent.append((d, given[0])) or plain(d, *given))
    out = registry.QUERIES["scored_reservoir"](spark, "/root/testdata/sf0.001")
    assert [(sorted(d.columns), keys) for d, keys in sent] == [(["market_id", "odd", "order_id", "outcome", "trader_id", "word"], ["trader_id"]), (["market_id", "odd", "order_id", "outcome", "t_p95", "word"], ["market_id", "outcome"])]
    assert sent[0][0].where("word is null").isEmpty() and sent[1][0].where("t_p95 is not null").count() < sent[1][0].count() and out.count()
