"""Sliding windows over panes: a pane is worked out once and shared by all windows it lies in."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def panes(d: DataFrame, keys: list[str], at: str, value: str, seconds: int = 60) -> DataFrame:
    """A row for each key and stretch of `seconds` with values: pane (its number), n, total, low, high and sizes, its values sorted."""
    v = F.col(value).cast("double")
    p = d.where(v.isNotNull()).groupBy(*keys, F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).alias("pane"))
    return p.agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.array_sort(F.collect_list(v)).alias("sizes"))


class Sorted:
    """Values in order, in blocks of at most twice `block`; adding, dropping and the n-th value touch one block."""

    def __init__(self, block: int = 1_000):
        self.block, self.blocks, self.size = block, [], 0

    def _at(self, v: float) -> int:
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][-1] < v:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def add(self, v: float) -> None:
        if not self.blocks:
            self.blocks.append([])
        k = self._at(v) if self.size else 0
        b = self.blocks[k]
        b.insert(bisect_left(b, v), v)
        self.size += 1
        if len(b) > 2 * self.block:
            self.blocks[k : k + 1] = [b[: self.block], b[self.block :]]

    def drop(self, v: float) -> None:
        k = self._at(v)
        b = self.blocks[k]
        del b[bisect_left(b, v)]
        self.size -= 1
        if not b and len(self.blocks) > 1:
            del self.blocks[k]

    def __getitem__(self, n: int) -> float:
        for b in self.blocks:
            if n < len(b):
                return b[n]
            n -= len(b)
        raise IndexError(n)

    def median(self) -> float:
        return (self[(self.size - 1) // 2] + self[self.size // 2]) / 2


def _fold(batches: Iterator[pa.RecordBatch], keys: int, width: int) -> Iterator[pa.RecordBatch]:
    """Panes of stretches in order, one stretch after the other: the keys, stretch, carried, pane, n, total, sizes."""
    stretch, last = None, None
    for b in batches:
        out, own = [], []
        of, carried, pane, n, total = (b.column(keys + k).to_pylist() for k in range(5))
        sizes = b.column(keys + 5)
        for i in range(b.num_rows):
            if of[i] != stretch or pane[i] < last:
                window, values, count, sums, stretch = deque(), Sorted(), 0, 0.0, of[i]
            last = pane[i]
            while window and window[0][0] <= pane[i] - width:
                _, k, _, gone = window.popleft()
                count -= k
                for v in gone:
                    values.drop(v)
            new = sizes[i].as_py()
            for v in new:
                values.add(v)
            window.append((pane[i], n[i], sums, new))
            count, sums = count + n[i], sums + total[i]
            if not carried[i]:
                own.append(i)
                out.append((pane[i], count, len(window), sums - window[0][2], values[0], values[count - 1], values.median()))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kept = b.take(pa.array(own, pa.int32())).columns[:keys]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*b.schema.names[:keys], "pane", "n", "panes", "total", "low", "high", "median"])


def windows(p: DataFrame, keys: list[str], width: int, seconds: int = 60) -> DataFrame:
    """For each pane the window of `width` panes that ends with it: start_at, end_at, n, panes (with values), total, mean, low, high,
    median and per_minute.

    A key is cut into stretches of `width` panes; each also gets the stretch before it, which is all its windows reach back
    to. A pane is thus added and dropped at most twice, whatever the number of windows it lies in, and a hot key is many tasks'
    work. A task holds the values of one window."""
    block = F.floor(F.col("pane") / width)
    place = lambda k, c: F.struct(k.alias("k"), F.lit(c).alias("c"))
    d = p.withColumn("_s", F.explode(F.array(place(block, False), place(block + 1, True)))).withColumns({"_k": F.col("_s.k"), "_c": F.col("_s.c")})
    d = d.repartition(*keys, "_k").sortWithinPartitions(*keys, "_k", "pane")
    d = d.select(*keys, F.xxhash64(*keys, "_k").alias("_g"), "_c", "pane", "n", "total", "sizes")
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 4
    names = ["pane", "n", "panes", "total", "low", "high", "median"]
    schema = T.StructType([*[d.schema[k] for k in keys], *[T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]])
    w = d.mapInArrow(lambda it: _fold(it, len(keys), width), schema)
    end = (F.col("pane") + 1) * seconds
    return w.select(*keys, F.timestamp_seconds(end - width * seconds).alias("start_at"), F.timestamp_seconds(end).alias("end_at"), "n", "panes", "total", (F.col("total") / F.col("n")).alias("mean"), "low", "high", "median", (F.col("n") * 60.0 / (width * seconds)).alias("per_minute"))
