"""Sharding by longest-processing-time scheduling (operator 3), law `bytes`.

Equal texts form a group that stays together. Groups, largest first, go to the least-loaded
shard through a heap. Groups of one size are interchangeable, so the heap runs over the table of
distinct sizes and their counts and says how many groups of each size every shard takes: exactly
what a heap over all groups gives.

At scale: only (key, size) rows are shuffled, never texts. The heap is one task's work; it streams the
table of distinct sizes, largest first, and holds a number per shard. Distinct sizes add up to no more than
all bytes, so there are fewer than the root of twice the bytes: 250,000 at most for 30 GB, 14 million for
100 TB. Group sums are combined map-side; a group of copies that holds a
third of all rows is one row after that, and its way back is an equi-join that Spark splits.
Ranks within a size and slots within a shard are ranks within buckets, whose number follows the rows, plus
bucket starts.

Null texts form one group, empty texts another; both have size 1 and checksum 0. Very long texts are
sized whole. Repeated rows and rows of one id each get a slot; columns besides id and text are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, distributed_rank

#: Rows of a bucket in which ranks are given out.
BUCKET_ROWS = 500_000


def lpt_counts(classes: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int]]]:
    """Per (size, groups), largest first: how many of the groups each shard takes.

    The same as popping the heap once per group; whole rounds over the lowest shards are done at once."""
    heap = [(0, s) for s in range(n_shards)]
    for size, count in classes:
        left = count
        took = [0] * n_shards
        while left:
            # The low shards are within one size of the lowest: the heap serves them in rounds
            # until they reach the next load.
            loads = sorted(heap)
            low = [x for x in loads if x[0] - loads[0][0] <= size]
            rounds = left // len(low)
            if len(low) < n_shards:
                rounds = min(rounds, (loads[len(low)][0] - low[-1][0]) // size)
            if rounds:
                for x in low:
                    took[x[1]] += rounds
                heap = [(x + rounds * size * (s in {i for _, i in low}), s) for x, s in loads]
                heapq.heapify(heap)
                left -= rounds * len(low)
            else:
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                took[s] += 1
                left -= 1
        yield size, took


def sharded(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """id, size, text_crc32, shard, slot.

    order names a long column whose order the slots of a shard follow (row numbers, or a file's or partition's
    number in the high bits and the row's below); without it they follow hashed ids."""
    t = F.col(text)
    d = docs.select(
        id_col, *([F.col(order).alias("_order")] if order else []), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(t.cast("binary"), 256)), F.unhex(F.lit("00"))).alias("_key"),
    )
    d = cut(d)
    buckets = max(512, d.count() // BUCKET_ROWS)
    groups = cut(d.groupBy("_key").agg(F.sum("size").alias("_bytes")))
    sizes = cut(groups.groupBy("_bytes").agg(F.count("*").alias("n")))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        part = []
        for size, took in lpt_counts(rows, n_shards):
            part.append((size, [sum(took[: k + 1]) for k in range(n_shards)]))
            if len(part) == 10_000:
                yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.list_(pa.int64()))], ["_bytes", "_ends"])
                part = []
        if part:
            yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.list_(pa.int64()))], ["_bytes", "_ends"])

    plans = cut(sizes.repartition(1).sortWithinPartitions(F.desc("_bytes")).mapInArrow(plan, "_bytes long, _ends array<long>"))
    ranked = distributed_rank(groups, ["_bytes"], ["_key"], F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"), "_rank")
    placed = ranked.join(plans, "_bytes").select("_key", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int").alias("shard"))
    out = cut(d.join(placed, "_key").drop("_key"))
    if order:
        return distributed_rank(out, ["shard"], ["_order", id_col], F.shiftright("_order", 14), "slot").drop("_order")
    return distributed_rank(out, ["shard"], [id_col], F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"), "slot")
