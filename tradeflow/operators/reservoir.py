"""Sliding order statistics: what the newest samples of a key say before each row is added to them."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeflow.operators.ranks import days, ordinal
from tradeflow.sources.scratch import kept as written


class Reservoir:
    """At most `samples` values, newest last, none older than `window` microseconds (None: any age)."""

    def __init__(self, samples: int, window: int | None):
        self.samples, self.window = samples, window
        self.clear()

    def clear(self) -> None:
        self.rows, self.sorted, self.sum = deque(), [], 0.0

    def _drop(self) -> None:
        _, v, _ = self.rows.popleft()
        del self.sorted[bisect_left(self.sorted, v)]

    def add(self, at: int, v: float) -> None:
        if len(self.rows) == self.samples:
            self._drop()
        self.rows.append((at, v, self.sum))
        self.sum += v
        insort(self.sorted, v)

    def read(self, at: int, quantiles: tuple[float, ...]) -> tuple:
        """Count, total, quantiles by nearest rank, oldest and newest; nulls when empty."""
        if self.window is not None:
            while self.rows and self.rows[0][0] < at - self.window:
                self._drop()
        n = len(self.rows)
        if not n:
            self.sum = 0.0
            return (0, 0.0, *[None] * len(quantiles), None, None)
        return (n, self.sum - self.rows[0][2], *[self.sorted[min(n, max(1, int(n * q + 0.5))) - 1] for q in quantiles], self.rows[0][0], self.rows[-1][0])


def _walk(batches: Iterator[pa.RecordBatch], width: int, samples: int, window: int | None, quantiles: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches, one after the other: `width` columns to keep, then stretch, place, carried, time and value."""
    held, stretch, last = Reservoir(samples, window), None, -1
    for b in batches:
        of, place, carried, at, value = (b.column(width + k).to_numpy(zero_copy_only=False) for k in range(5))
        out = []
        for k, p, c, t, v in zip(of.tolist(), place.tolist(), carried.tolist(), at.tolist(), value.tolist(), strict=True):
            if k != stretch or p < last:
                held.clear()
                stretch = k
            last = p
            if not c:
                out.append(held.read(t, quantiles))
            if v > 0:
                held.add(t, v)
        own = pa.RecordBatch.from_arrays(b.columns[:width], b.schema.names[:width]).filter(pa.array(~carried.astype(bool)))
        kinds = [pa.int64(), pa.float64(), *[pa.float64()] * len(quantiles), pa.int64(), pa.int64()]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*own.columns, *cols], [*own.schema.names, *[f"_r{i}" for i in range(len(cols))]])


def _small(d: DataFrame, keys: list[str], order: list[str], opened: dict[str, Column]) -> DataFrame:
    """Rows of keys that are walked whole."""
    return d.repartition(*keys).withColumns(opened).sortWithinPartitions(*keys, *order)


def _cut(d: DataFrame, keys: list[str], order: list[str], bucket: Column, samples: int, stretch: int) -> DataFrame:
    """Rows of large keys with _k, their stretch, and _c, whether they are there for the next one only."""
    d = ordinal(d, keys, order, bucket, "_place", F.col("_v") > 0)
    own = F.floor(F.col("_place") / stretch)
    late = (F.col("_v") > 0) & (F.col("_place") % stretch >= stretch - samples)
    place = lambda k, c: F.struct(k.cast("long").alias("k"), F.lit(c).alias("c"))
    d = d.withColumn("_s", F.explode(F.when(late, F.array(place(own, False), place(own + 1, True))).otherwise(F.array(place(own, False)))))
    return d.withColumns({"_k": F.col("_s.k"), "_c": F.col("_s.c")}).repartition(*keys, "_k").sortWithinPartitions(*keys, "_k", "_place", F.desc("_c"), *order)


def before(t: DataFrame, keys: list[str], order: list[str], at: str = "traded_at", value: str = "notional", samples: int = 1_024, window_days: float | None = None, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), stretch: int = 16_384, bucket_days: int = 365,
           counted: DataFrame | None = None, opened: dict[str, Column] | None = None) -> DataFrame:
    """t with n, total, a p<hundredths> for each quantile, oldest and newest of the key's reservoir before each row.

    A reservoir holds the newest `samples` positive values of earlier rows in `order` (at first), those older than
    window_days before the row's time left out. Quantiles are by nearest rank; with no sample n and total are 0, the rest null.
    Rows without a positive value are judged but never enter.

    A key of more than `stretch` rows is cut into stretches of consecutive samples; each also gets the `samples` before it, so a stretch
    needs no other and a key of any size is walked by many tasks. Rows of other keys are sent once, by key. A task holds one reservoir,
    not a stretch. t is read twice, and twice more where there are large keys. With `counted`, which has the keys of t's rows and is
    cheaper to read, t is read once, and written first where there are large keys. `opened` are columns worked out of t's where rows
    arrive, so that they are not sent: order, at and value may be among them, and they do not come out."""
    if not 0 < samples <= stretch:
        raise ValueError("a stretch holds at least a reservoir")
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    kept, opened = t.columns, opened or {}
    kind = t.withColumns(opened).schema[at].dataType
    # Worked out where they are used: rows are sent as they are.
    entry = {"_v": F.when(F.isnan(v), 0.0).otherwise(v), "_t": F.unix_micros(F.col(at).cast("timestamp"))}
    large = written((t if counted is None else counted).groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_rows")).where(F.col("_rows") > stretch))
    whole = F.lit(0).cast("long")
    of_whole = lambda d: _small(d, keys, order, opened).select(*kept, F.xxhash64(*keys, whole).alias("_g"), whole.alias("_place"), F.lit(False).alias("_c"), entry["_t"].alias("_t"), entry["_v"].alias("_v"))
    if large.isEmpty():
        d = of_whole(t)
    else:
        t = t if counted is None else written(t)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
        of = F.broadcast(large)  # a row for each `stretch` rows of t at most
        d = _cut(t.join(of, same, "left_semi").withColumns(opened).withColumns(entry), keys, order, days(at, bucket_days), samples, stretch)
        d = of_whole(t.join(of, same, "left_anti")).union(d.select(*kept, F.xxhash64(*keys, "_k").alias("_g"), "_place", "_c", "_t", "_v"))
    names = [f"p{round(100 * q)}" for q in quantiles]
    kinds = [T.LongType(), *[T.DoubleType()] * (len(quantiles) + 1), T.LongType(), T.LongType()]
    schema = T.StructType([*[d.schema[c] for c in kept], *[T.StructField(f"_r{i}", k) for i, k in enumerate(kinds)]])
    window = None if window_days is None else int(window_days * 86_400_000_000)
    out = d.mapInArrow(lambda it: _walk(it, len(kept), samples, window, quantiles), schema)
    time = lambda i: F.timestamp_micros(F.col(f"_r{i}")).cast(kind)
    n = len(quantiles)
    return out.select(*kept, F.col("_r0").alias("n"), F.col("_r1").alias("total"), *[F.col(f"_r{i + 2}").alias(c) for i, c in enumerate(names)], time(n + 2).alias("oldest"), time(n + 3).alias("newest"))


def brute(rows: list[tuple], samples: int, window: float | None, quantiles=(0.5, 0.95, 0.99)) -> list[tuple]:
    """What `before` gives for one key's (time in seconds, value) in order, worked out plainly; for tests."""
    out = []
    for i, (at, _) in enumerate(rows):
        seen = [(t, v) for t, v in rows[:i] if v and v > 0][-samples:]
        seen = [(t, v) for t, v in seen if window is None or t >= at - window]
        s = np.sort([v for _, v in seen])
        out.append((len(s), float(s.sum()), *[float(s[min(len(s), max(1, int(len(s) * q + 0.5))) - 1]) if len(s) else None for q in quantiles]))
    return out
