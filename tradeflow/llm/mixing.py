"""Mixing sources to target weights by Pfair scheduling (operator 8).

Each source's documents, in a keyed shuffle, are laid out in blocks of `block_bytes`. The i-th
block of a source of weight w is released at floor((i-1)/w) and due at ceil(i/w); of the
released blocks the one with the earliest deadline takes the next slot. With weights that sum
to one every prefix of the schedule holds each source's share to within less than one block.

When a source has no block left, the other weights are scaled up and the schedule goes on from
there, so every document is placed exactly once. Weights are taken as exact fractions: the slots
are walked one after another, with one pending block a source, so the bound holds for schedules
of any length and any number of sources.

At scale: narrow rows only, and no row of them reaches the driver. The walk is one task that holds a heap of
sources and writes a row for each block, not for each document. Positions of a hot source are prefix sums over
buckets, whose number follows the rows, so no task holds a source.

Null sources are a source of their own. Null and empty texts count one byte, very long ones their whole size.
Repeated rows and rows without an id each get a position; columns that are not asked for are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, distributed_rank

#: Rows of a bucket in which positions are given out.
BUCKET_ROWS = 500_000


def earliest_deadlines(q: dict) -> Iterator:
    """The source of each slot by earliest deadline first, without end; q are whole weights of any size.

    A source's next block is released no earlier than the slot its last one is due in, so one
    pending block a source is enough."""
    n = sum(q.values())
    later = [(0, -(-n // k), s, 1) for s, k in q.items()]
    heapq.heapify(later)
    ready, t = [], 0
    while True:
        while later and later[0][0] <= t:
            _, due, s, i = heapq.heappop(later)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        heapq.heappush(later, (i * n // q[s], -(-(i + 1) * n // q[s]), s, i + 1))
        yield s
        t += 1


def walk(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block) of each slot by the exact weights. Where a source is asked for more than it has, a
    new phase begins with the sources that are left."""
    done, left = dict.fromkeys(blocks, 0), {s for s, n in blocks.items() if n}
    while left:
        exact = {s: Fraction(weights[s]) for s in left}
        unit = math.lcm(*[w.denominator for w in exact.values()])
        for s in earliest_deadlines({s: int(exact[s] * unit) for s in sorted(left)}):
            if done[s] == blocks[s]:
                break
            yield s, done[s]
            done[s] += 1
        left = {s for s in left if done[s] < blocks[s]}


def mixed(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, block_bytes: int = 65_536,
          seed: int = 17, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, block, slot, position: position is gapless from 0 over all documents.

    weights gives each source's target share; sources that it lacks, or all if it is None,
    weigh their bytes to the power `temperature`."""
    d = docs.select(
        F.col(id_col), F.col(source).alias("_source"), F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long").alias("_bytes"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_order"),
    )
    d = cut(d)
    bits = max(9, math.ceil(math.log2(max(1, d.count() / BUCKET_ROWS))))
    held = cut(d.groupBy("_source").agg(F.sum("_bytes").alias("b")))
    asked = weights or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        names = sorted(known, key=lambda s: (s is not None, s))
        target = {i: asked.get(s) or Fraction(max(1, round(known[s] ** temperature * 1000))) for i, s in enumerate(names)}
        slots, at = walk({i: -(-known[s] // block_bytes) for i, s in enumerate(names)}, target), 0
        while rows := list(islice(slots, 50_000)):
            yield pa.record_batch([pa.array([_key(names[i]) for i, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())], ["_s", "block", "slot"])
            at += len(rows)

    placed = cut(held.repartition(1).mapInArrow(run, "_s string, block long, slot long"))
    total = max(1, placed.count())
    order = distributed_rank(d, ["_source"], ["_order", id_col], F.shiftright(F.col("_order"), 64 - bits).cast("int"), "_before", weight="_bytes")
    order = order.withColumn("block", F.floor(F.col("_before") / block_bytes).cast("long"))
    order = cut(order.select(id_col, F.coalesce(F.concat(F.lit("v"), "_source"), F.lit("n")).alias("_s"), "_source", "block", "_before"))
    j = order.join(placed, ["_s", "block"]).select(id_col, F.col("_source").alias("source"), "block", "slot", "_before")
    return distributed_rank(j, [], ["slot", "_before", id_col], F.floor(F.col("slot") * 2**max(12, bits) / total).cast("int"), "position").drop("_before")


def _key(source: str | None) -> str:
    return "n" if source is None else "v" + source
