import random
from fractions import Fraction
from itertools import islice

from tradeflow.llm import mixing


def test_mix(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3 if i % 7 else 0}") for i in range(2000)] + [(3000, None, None), (3001, "", None), (3002, "y" * 5000, "s1")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"s0": 5, "s1": 1}, block_bytes=300).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows))) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    got.sort(key=lambda r: r["position"])
    assert [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    owner = {}
    for r in got:
        assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])


def test_empty_and_repeated_rows(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string, slot int")).count() == 0
    d = spark.createDataFrame([(1, "a", "s")] * 5, "doc_id long, text string, source string")
    assert mixing.mixed(d).count() == 5


def test_deviation_from_the_target_weights(spark):
    """Less than one block at every slot, against the weights as asked and not as rounded, far beyond 1,000 slots."""
    r = random.Random(3)
    for weights in ({0: Fraction(1, 10_000), 1: Fraction(9_999, 10_000)}, {i: r.randrange(1, 90_000) for i in range(20)}, {0: 0.3, 1: 0.00047, 2: 1.7}):
        exact = {s: Fraction(w) for s, w in weights.items()}
        share = {s: w / sum(exact.values()) for s, w in exact.items()}
        done = dict.fromkeys(weights, 0)
        for t, (s, block) in enumerate(islice(mixing.walk(dict.fromkeys(weights, 10**6), weights), 20_000), 1):
            assert block == done[s]
            done[s] += 1
            assert abs(share[s] * t - done[s]) < 1
            assert t % 97 or all(abs(share[x] * t - done[x]) < 1 for x in done)
    rows = [(i, "x" * 10, "rare" if i % 10 == 0 else f"s{i % 3}") for i in range(30_000)]
    weights = {"rare": Fraction(1, 5_000), "s0": Fraction(1_999, 5_000), "s1": Fraction(3, 10), "s2": Fraction(3, 10)}
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_bytes=10).where("slot < 12000").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in got}
    assert sum(got.values()) == 12_000 and all(abs(weights[s] * 12_000 - got.get(s, 0)) < 1 for s in weights)


def test_walk_places_every_block_once():
    blocks = {0: 5, 1: 1203, 2: 77, 3: 0}
    assert sorted(mixing.walk(blocks, {0: 3, 1: 1, 2: 2, 3: 9})) == [(s, b) for s, c in blocks.items() for b in range(c)]


def test_query_keeps_to_its_weights(spark):
    """The query's own output, at every slot, while all sources have blocks."""
    from tradeflow.llm import queries

    sf = "/root/testdata/sf0.01"
    size = {r["source"]: r["b"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source", "greatest(octet_length(text), 1) AS b").groupBy("source").agg({"b": "sum"}).withColumnRenamed("sum(b)", "b").collect()}
    share = {s: Fraction(max(1, round(b**0.5 * 1000))) for s, b in size.items()}
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in queries.op8_mixing(spark, sf).collect()})
    done, left = dict.fromkeys(size, 0), {s: -(-b // 65_536) for s, b in size.items()}
    for t, (slot, s, block) in enumerate(slots, 1):
        done[s] += 1
        if any(done[x] == left[x] for x in left):
            break
        assert all(abs(share[x] / sum(share.values()) * (slot + 1) - done[x]) < 2 for x in share)  # a block of one long text is empty


def test_many_sources_and_rows_without_an_id(spark):
    rows = [(i if i % 9 else None, "x" * (i % 30), f"host{i % 3001}", 5) for i in range(6000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, position int"), block_bytes=20).collect()
    assert sorted(r["position"] for r in got) == list(range(6000)) and len({r["source"] for r in got}) == 3001
