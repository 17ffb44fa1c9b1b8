import heapq
import random
import zlib
from collections import defaultdict

from tradeflow.llm import sharding


def lpt(sizes, n):
    heap, took = [(0, s) for s in range(n)], defaultdict(lambda: [0] * n)
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        took[size][s] += 1
        heapq.heappush(heap, (load + size, s))
    return sorted(x for x, _ in heap), took


def test_counts_equal_the_plain_heap():
    r = random.Random(2)
    for case in range(60):
        sizes = [r.choice([1, 2, 3, 50, r.randrange(1, 2000)]) for _ in range(r.randrange(0, 300))] + ([100_000] if case % 3 == 0 else [])
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        plan = list(sharding.lpt_counts(sorted(counts.items(), reverse=True), 5))
        loads = [sum(k * took[s] for k, took in plan) for s in range(5)]
        assert sorted(loads) == lpt(sizes, 5)[0] and all(sum(t) == counts[k] for k, t in plan)


def test_one_huge_group_and_many_small_ones_is_quick():
    plan = list(sharding.lpt_counts([(10**12, 1), (1000, 10**10)], 8))
    loads = [sum(k * t[s] for k, t in plan) for s in range(8)]
    assert max(loads) - min(loads) <= 1000


def test_query_contract(spark):
    rows = [(i, "t" * (i % 37)) for i in range(300)] + [(300 + i, None) for i in range(3)] + [(400, "é" * 5000), (401, "big" * 9000), (401, "big" * 9000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for (_, t), _ in zip(rows, got, strict=True):
        by[t]
    text = dict(rows)
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        by[t].add(r["shard"])
    assert all(len(s) == 1 for s in by.values()) and {r["shard"] for r in got} <= set(range(8))
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_balance(spark):
    got = sharding.sharded(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.001 * sum(loads)


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loads_are_those_of_the_plain_heap(spark):
    """Large groups of many sizes, nulls, an empty text, repeated rows and clashing names: every load is that of a heap over all groups."""
    r = random.Random(5)
    rows = [(i, "ab" * r.randrange(5_000, 40_000), 1, 2, 3) for i in range(120)] + [(200 + i, r.choice(["q", "w"]) * r.randrange(0, 40), 1, 2, 3) for i in range(400)] + [(None, None, 1, 2, 3), (7, None, 1, 2, 3), (8, "", 1, 2, 3), (8, "", 1, 2, 3)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, shard int, size int, slot int"), n_shards=5)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[t] += len((t or "").encode()) + 1
    assert sorted(x["b"] for x in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()) == lpt(groups.values(), 5)[0]
