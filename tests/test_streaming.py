import random
from datetime import datetime, timedelta

from tradeflow.streaming import feeds

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, parts=3):
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return feeds.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)


def test_first_seen(spark, tmp_path):
    rows = [(i % 10, T0 + timedelta(minutes=i)) for i in range(40)]
    s = stream(spark, tmp_path, rows, "id int, ts timestamp")
    assert feeds.drain(feeds.first_seen(s, ["id"]), str(tmp_path / "seen"), "append", str(tmp_path / "c")).count() == 10


def test_bars_equal_batch(spark, tmp_path):
    rows = [("a" if i % 2 else "b", float(i), T0 + timedelta(seconds=37 * i)) for i in range(100)]
    schema = "k string, v double, ts timestamp"
    s = stream(spark, tmp_path, rows, schema)
    got = feeds.drain(feeds.bars(s, "k", "v"), str(tmp_path / "bars"), "complete", str(tmp_path / "c"))
    want = feeds.bars(spark.createDataFrame(rows, schema), "k", "v")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_work_items(spark, tmp_path):
    rows = [("m", "move", T0 + timedelta(seconds=20 * i)) for i in range(12)]
    s = stream(spark, tmp_path, rows, "market string, reason string, ts timestamp")
    assert feeds.drain(feeds.work_items(s, ["market", "reason"]), str(tmp_path / "work"), "append", str(tmp_path / "c")).count() == 4


def test_moves_with_cooldown(spark, tmp_path):
    mids = [0.50, 0.505, 0.53, 0.56, 0.60, 0.60]
    rows = [("m", x, T0 + timedelta(seconds=25 * i)) for i, x in enumerate(mids)]
    s = stream(spark, tmp_path, rows, "market string, mid double, ts timestamp", parts=2)
    got = sorted(r["mid"] for r in feeds.drain(feeds.moves(s, "market", "mid"), str(tmp_path / "moves"), "append", str(tmp_path / "c")).collect())
    assert got == [0.53]  # the next two are within its cool-down


def test_moves_leave_in_pieces(spark, tmp_path, monkeypatch):
    """A hot key's triggers are not gathered; rows come unsorted, tied, null and of nothing, over batches."""
    r = random.Random(3)
    rows = [(k, None if i % 11 == 0 else float(r.randrange(4)), T0 + timedelta(seconds=(i // 50) * 50 + r.randrange(25))) for i in range(300) for k in ("a", "b")]
    s = stream(spark, tmp_path, rows, "market string, mid double, ts timestamp")
    monkeypatch.setattr(feeds, "PIECE", 7)
    got = sorted((x["market"], x["at"], x["before"], x["mid"]) for x in feeds.drain(feeds.moves(s, "market", "mid", least=0.5, cooldown_s=0.0), str(tmp_path / "moves"), "append", str(tmp_path / "c")).collect())
    want = []
    for k in ("a", "b"):
        last = None
        for at, m in sorted((t, m) for kk, m, t in rows if kk == k and m is not None):
            if last and abs(m - last) / last >= 0.5:
                want.append((k, at, last, m))
            last = m
    assert got == sorted(want) and len(got) > 50


def test_moves_hold_no_pieces_back(spark, tmp_path):
    """More triggers than a piece holds."""
    n = feeds.PIECE + 10
    d = spark.range(n).selectExpr("'m' AS market", "CAST(1 + id % 2 * 9 AS double) AS mid", "timestamp_micros(1704067200000000 + id * 1000) AS ts")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = feeds.files(spark, str(tmp_path / "in"), d.schema, 1)
    assert feeds.drain(feeds.moves(s, "market", "mid", cooldown_s=0.0), str(tmp_path / "moves"), "append", str(tmp_path / "c")).count() == n - 1
