"""Leases of a work queue, and trades that come too late for an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeflow.sources.sink import append


def leased(claims: DataFrame, results: DataFrame, ttl: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """claims (item, claimed_at, attempt) with the result that came within ttl: result_at and status, `done` or `expired`.

    A stream of claims meets a stream of results (item, result_at). A claim without a result in time comes out once the watermark has
    passed its end, as expired: its item goes back to the queue. Both sides leave the state when their time is over."""
    c = claims.select("item", F.col("claimed_at").cast("timestamp").alias("claimed_at"), "attempt").withWatermark("claimed_at", late)
    r = results.select(F.col("item").alias("_item"), F.col("result_at").cast("timestamp").alias("result_at")).withWatermark("result_at", late)
    on = F.expr(f"item = _item AND result_at >= claimed_at AND result_at <= claimed_at + INTERVAL {ttl}")
    d = c.join(r, on, "leftOuter")
    return d.select("item", "claimed_at", "attempt", "result_at", F.when(F.col("result_at").isNull(), "expired").otherwise("done").alias("status"))


def queued_again(settled: DataFrame, most: int = 3) -> DataFrame:
    """Items of expired leases that may be tried again: item, attempt (the next one) and available_at, the end of the lease."""
    return settled.where((F.col("status") == "expired") & (F.col("attempt") < most)).select("item", (F.col("attempt") + 1).alias("attempt"), "claimed_at")


def split_late(rows: DataFrame, at: str, lag: str, path: str, checkpoint: str) -> None:
    """Drains a stream into three tables below path: stored (every row), fresh (rows to alert on) and marks (a row a batch).

    A row is late when it lies more than `lag` behind the newest time of its own and all earlier batches. Each table is written
    by batch id, so a batch that runs again replaces itself in all three; the mark of a batch is worked out from the marks
    before it and the batch's stored rows, never from memory, so a restart goes on where it stopped."""
    spark, schema = rows.sparkSession, rows.schema
    marks_schema, with_batch = "newest timestamp_ntz, batch int", T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    append(spark.createDataFrame([], schema), f"{path}/stored", "-1")
    append(spark.createDataFrame([], schema), f"{path}/fresh", "-1")
    append(spark.createDataFrame([], "newest timestamp_ntz"), f"{path}/marks", "-1")

    def write(batch_rows: DataFrame, batch: int) -> None:
        append(batch_rows, f"{path}/stored", str(batch))
        stored = batch_rows.sparkSession.read.schema(with_batch).parquet(f"{path}/stored").where(F.col("batch") == batch).drop("batch")
        marks = batch_rows.sparkSession.read.schema(marks_schema).parquet(f"{path}/marks").where(F.col("batch") < batch)
        newest = marks.select("newest").unionByName(stored.select(F.col(at).cast("timestamp_ntz").alias("newest"))).agg(F.max("newest").alias("newest"))
        append(newest, f"{path}/marks", str(batch))
        mark = batch_rows.sparkSession.read.schema(marks_schema).parquet(f"{path}/marks").where(F.col("batch") == batch).first()
        fresh = stored.where(F.col(at).cast("timestamp_ntz") >= F.lit(mark["newest"]).cast("timestamp_ntz") - F.expr(f"INTERVAL {lag}")) if mark and mark["newest"] is not None else stored.where("false")
        append(fresh, f"{path}/fresh", str(batch))

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stored(spark, path: str, schema) -> DataFrame:
    """The rows of split_late's table at path, without their batch."""
    return spark.read.schema(schema).parquet(path)
