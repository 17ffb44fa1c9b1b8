"""Streams of trades and book events: deduplication, windows, live state and triggers.

Each function takes a streaming (or, for tests, a static) DataFrame and returns one; sinks are
the caller's. State is bounded by watermarks, or by one row per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradeflow.sources.sink import append


#: Rows of a key that come out of a Python worker at once.
PIECE = 50_000


def files(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A directory of Parquet files as a stream; files_per_trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(rows: DataFrame, path: str, arrival: Column, days: int = 5) -> None:
    """Adds rows to the folder at path as a feed would: a file for each stretch of `days` that rows arrive in, one after the other.

    A stretch is looked for by all tasks and written by one, in row groups that as many can read."""
    d = rows.withColumn("_slice", F.floor(F.unix_micros(arrival.cast("timestamp")) / (days * 86_400_000_000)))
    for r in d.select("_slice").distinct().orderBy("_slice").collect():  # a row a stretch
        d.where(F.col("_slice") == r["_slice"]).drop("_slice").repartition(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(path)


def first_seen(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: redelivered events are dropped, rows later than it are too."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def bars(events: DataFrame, key: str, value: str, at: str = "ts", width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding bars: count, sum, low, high."""
    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", width, slide) if slide else F.window("_at", width)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select(key, F.col("w.start").alias("bar_at"), "n", "total", "low", "high")


def work_items(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row for keys and minute."""
    e = events.withColumn("minute", F.date_trunc("minute", F.col(at).cast("timestamp"))).withWatermark("minute", late)
    return e.dropDuplicates([*keys, "minute"]).select(*keys, "minute")


def moves(events: DataFrame, key: str, mid: str, at: str = "ts", least: float = 0.03, cooldown_s: float = 60.0) -> DataFrame:
    """Rows whose mid differs from the key's mid before by `least` or more, with a cool-down a key.

    A row is compared with the state before it updates it. The state is one (mid, time) a key."""
    schema = f"{key} string, at timestamp, mid double, before double, change double"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, quiet = state.get if state.exists else (None, None)
        # Of one key of one micro-batch two numbers a row are held, and what comes out leaves in pieces.
        parts = [(b["_at"].to_numpy()[ok], b["_mid"].to_numpy(dtype="float64")[ok]) for b in batches for ok in [b["_mid"].notna().to_numpy()]]
        at_, m = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        del parts
        order = np.lexsort((m, np.where(np.isnat(at_), np.iinfo("int64").max, at_.astype("int64"))))
        at_, m = at_[order], m[order]
        del order
        before = np.concatenate([[np.nan if last is None else last], m[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            hits = np.flatnonzero((before != 0) & (np.abs(m - before) / np.abs(before) >= least))
        if cooldown_s > 0 or quiet is not None:
            own = []
            for i in hits.tolist():
                now = pd.Timestamp(at_[i]).timestamp()
                if quiet is None or now >= quiet:
                    own.append(i)
                    quiet = now + cooldown_s
            hits = np.array(own, dtype="int64")
        elif len(hits):
            quiet = pd.Timestamp(at_[hits[-1]]).timestamp()
        if len(m):
            state.update((float(m[-1]), quiet))
        elif last is not None:
            state.update((float(last), quiet))
        for i in range(0, max(1, len(hits)), PIECE):
            x = hits[i : i + PIECE]
            yield pd.DataFrame({key: [k[0]] * len(x), "at": at_[x], "mid": m[x], "before": before[x], "change": (m[x] - before[x]) / before[x]})

    e = events.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias("_at"), F.col(mid).cast("double").alias("_mid"))
    return e.groupBy(key).applyInPandasWithState(step, schema, "last double, quiet double", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the queries started inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream to the end of what is there into a Parquet table at path and returns its rows; for tests and back-fills.

    append: a batch is a partition, which a batch that runs again replaces. complete: each batch is the table."""
    spark, columns = stream.sparkSession, stream.columns
    append(spark.createDataFrame([], stream.schema), path, "none")  # the table is there even if no batch runs

    def write(rows: DataFrame, batch: int) -> None:
        if mode == "complete":
            rows.write.mode("overwrite").parquet(path)
        else:
            append(rows, path, str(batch))

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*columns)
