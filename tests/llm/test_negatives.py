"""Hard negatives against brute force on the same integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeflow.llm import negatives


def brute(rows, is_anchor, n_positives=5, n_negatives=3, low=50, high=95):
    """rows: (id, label, vector)."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, q) in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-dot(q, v), i, c) for i, (c, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            ok = [(i, -t) for t, i, c in scored if c != label and low * -s <= 100 * -t <= high * -s][:n_negatives]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(ok)]
    return sorted(out)


def run(spark, rows, every=5, **kw):
    d = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    d = d.selectExpr("*", "1 AS id", "2 AS q", "3 AS anchor", "4 AS score")
    got = negatives.mined(d, F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes)["rank"] == "int" and {t for c, t in got.dtypes if c != "rank"} == {"bigint"}
    return sorted(tuple(r) for r in got.collect())


def some(n, d, seed, labels=3, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * 0.5 + rng.normal(size=d) * spread
        out.append((i, label, [float(x) for x in v / np.linalg.norm(v)]))
    return out


@pytest.mark.parametrize(("n", "d", "seed"), [(150, 8, 1), (150, 33, 2), (60, 1, 3), (90, 2, 4)])
def test_against_brute_force(spark, monkeypatch, n, d, seed):
    monkeypatch.setattr(negatives, "TILE_ROWS", 40 * d)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 7 * d)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = some(n, d, seed)
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    rows = some(60, 6, 7)
    common = rows[3][2]
    rows += [(100 + i, i % 3, common) for i in range(60)]  # one vector a third of all rows
    rows += [(None, 1, common), (200, None, common), (201, 1, None), (205, 1, [1.0, None, 2.0]), (210, 1, [float("nan")] * 6), (215, 2, [float("inf")] * 6), (220, 1, []), (225, 2, common[:3]), (230, 9, common)]
    rows += [rows[5], rows[5], (5, 0, common), (10, 2, [0.0] * 6)]  # repeated rows and ids of several rows
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, rows, every=1, n_positives=2, n_negatives=1, low=0, high=100) == brute(rows, lambda i: True, 2, 1, 0, 100)


def test_empty_and_without_anchors(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    with pytest.raises(ValueError):
        run(spark, [(5, 1, [1e6] * 8)])


def table(rows, scores=None):
    q = [[math.floor(256 * x) for x in v] for _, _, v in rows]
    cols = {"id": [i for i, _, _ in rows], "label": [c for _, c, _ in rows], "q": pa.array(q, pa.list_(pa.int32()))}
    return pa.table(cols | ({"scores": pa.array(scores, pa.list_(pa.int64()))} if scores else {}))


def test_most_pairs_are_dropped_before_their_product(monkeypatch):
    """Vectors near a few axes: the leading components decide."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    scales = 0.8 ** np.arange(64)
    rows = [(i, i % 4, list((rng.normal(size=64) * scales) @ basis)) for i in range(2_000)]
    rows = [(i, c, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, c, v in rows]
    a, x = table(rows[:100]), table(rows)
    turn = negatives.axes(negatives.matrix(x["q"], 64))
    seen = []
    negatives.positives(a, x, turn, 5, seen)
    assert sum(seen) < 0.1 * 100 * 2_000 / 4
    # A bound is never below what it bounds.
    s, t = negatives.Side(a["id"].to_numpy(), negatives.matrix(a["q"], 64), turn), negatives.Side(x["id"].to_numpy(), negatives.matrix(x["q"], 64), turn)
    exact = s.whole @ t.whole.T
    for m, r, u in zip(s.stages, s.rests, t.rests, strict=True):
        part, rest = s.turned[:, :m] @ t.turned[:, :m].T, np.outer(r, u) + negatives.slack(turn) * np.outer(s.norm, t.norm)
        assert (exact <= part + rest).all() and (exact >= part - rest).all()


def test_axes_do_not_change_results():
    rows = some(80, 16, 11)
    a, x = table(rows[:20]), table(rows)
    for turn in (np.eye(16), negatives.axes(negatives.matrix(x["q"], 16)), np.linalg.qr(np.random.default_rng(3).normal(size=(16, 16)))[0]):
        got = negatives.positives(a, x, turn, 5)
        first = got.ids if turn[0, 0] == 1 and turn[0, 1] == 0 else first  # noqa: F821
        assert (got.ids == first).all()
