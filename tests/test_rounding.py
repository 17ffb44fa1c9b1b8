"""Doubles are rounded as the queries' SQL rounds them, halves included."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tradeflow.functions.rounding import rounded
from tradeflow.plans import flow, registry

#: Moves between two values of events whose sixth digit Spark's own round takes the other way.
MOVES = [0.6459374999999999, 4.0609375, 2.0109375, 8.0359375, 4.1859375, 4.1234375, 0.5203125, 1.0171875, 1.0484375]
ODD = [None, 0.0, 0.5, -0.0000005, 1e-300, 1e300, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 123456789.1234565]


@pytest.mark.parametrize("digits", [0, 2, 4, 6, 8])
def test_rounded_is_what_sql_gives(spark, digits):
    xs = [s * x if x is not None else None for x in MOVES + ODD + [k / 2**i for i in (1, 5, 7, 9) for k in range(1, 2_000, 37)] for s in (1, -1)]
    d = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", rounded(F.col("x"), digits).alias("y"))
    assert dict(d.dtypes)["y"] == "double"
    got = [r["y"] for r in d.orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, ?::INT)", [x, digits]).fetchone()[0] for x in xs]
    assert [repr(y) if y != 0 else "0" for y in got] == [repr(y) if y != 0 else "0" for y in want]


def test_columns_of_a_table_are_rounded_as_in_sql_and_keep_their_types(spark):
    d = flow.rounded(spark.createDataFrame([(x, 12_345, None) for x in MOVES], "x double, n long, y double"), "x", "n", "y", digits=6)
    assert d.dtypes == [("x", "double"), ("n", "bigint"), ("y", "double")]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in MOVES]
    assert [tuple(r) for r in d.collect()] == [(x, 12_345, None) for x in want]


def test_triggers_round_a_move_as_their_sql_does(spark, tmp_path):
    """Two markets, each with a mid and, a day later, one whose move is a half in the seventh digit; and an end, so that they are due."""
    mids = [(6.4, 32.39), (6.4, 9.73)]
    rows = [(4 * i + k, 10 * i + k, m) for i, pair in enumerate(mids) for k, m in enumerate(pair)] + [(99, 90, 1.0)]
    d = spark.createDataFrame(rows, "event_id long, day int, value double").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day) AS ts", "event_id div 4 AS user_id", "'view' AS event_type", "value", "'' AS props")
    d.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["market"], r["reason"], r["change"]) for r in registry.QUERIES["stream_triggers"](spark, f"file://{tmp_path}").collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = sorted((m, reason, change) for m, _, reason, _, change in db.execute(registry.ORACLE["stream_triggers"]).fetchall())
    assert got == want and len(want) == 4
