"""Vector codes against brute force on the same integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeflow.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, label, vector); sorted (id, code, error, label_error, sha)."""
    kept = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(q) for _, _, q in kept) // parts))
    kept = [(i, c, q + [0] * (parts * width - len(q))) for i, c, q in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, _, q in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for p in range(parts):
            for _, _, q in kept:
                held[p][near(cut(q, p), p)[1]].append(cut(q, p))
        books = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := held[p].get(k)) else e for k, e in enumerate(books[p])] for p in range(parts)]
    done, by = [], defaultdict(int)
    for i, c, q in kept:
        found = [near(cut(q, p), p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by[c] += error
        done.append((i, c, "".join(f"{k:02x}" for _, k in found), error))
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, code, e, by[c], sha) for i, c, code, e in done), key=str)


def run(spark, rows, **kw):
    d = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>").selectExpr("*", "1 AS id", "2 AS q", "3 AS error", "4 AS code")
    got = codes.encoded(d, **kw)
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    return sorted((tuple(r) for r in got.collect()), key=str)


def some(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(labels)), [float(x) for x in rng.normal(size=d) / np.sqrt(d)]) for i in rng.permutation(n)]


@pytest.mark.parametrize(("n", "d", "kw"), [(200, 32, {}), (40, 16, {}), (120, 12, {"parts": 3, "entries": 20, "rounds": 4}), (70, 10, {"parts": 4, "entries": 256, "rounds": 1}), (30, 8, {"parts": 2, "entries": 5, "rounds": 0})])
def test_against_brute_force(spark, n, d, kw):
    rows = some(n, d, n)
    assert run(spark, rows, **kw) == brute(rows, **kw)


def test_odd_rows(spark):
    rows = some(60, 16, 3)
    common = rows[0][2]
    rows += [(1_000 + i, 2, common) for i in range(40)]  # one vector, equal entries
    rows += [(None, 1, common), (None, None, rows[4][2]), (7_000, None, rows[5][2]), (7_001, 3, None), (7_002, 3, [1.0, None]), (7_003, 3, [float("nan")]), (7_004, 3, [float("-inf")] * 16), (7_005, 3, []), (7_006, 3, common[:5]), rows[6], rows[6], (rows[6][0], 1, common)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(i, 1, common) for i in range(100)]) == brute([(i, 1, common) for i in range(100)])
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []


ints = st.integers(-40, 40)


@given(st.lists(st.tuples(ints, ints, ints), min_size=1, max_size=64), st.lists(st.tuples(ints, ints, ints), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_tree_is_exact(entries, points):
    e, p = np.array(entries, np.int64), np.array(points, np.int64)
    index, far = codes.BallTree(e).nearest(p)
    d = ((p[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    assert (far == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_tree_visits_few_entries():
    rng = np.random.default_rng(1)
    tree = codes.BallTree(rng.integers(-100, 100, size=(64, 4)))
    tree.nearest(rng.integers(-100, 100, size=(5_000, 4)))
    assert tree.visited < 0.5 * 5_000 * 64
