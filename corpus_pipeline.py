"""A corpus pipeline: five stages over documents, each one of the training-data operators.

Every stage but the last returns the columns it got; each is written as Parquet and read again
as the next one's docs. Rows with null columns, empty texts and repeated rows go through all stages;
rows of one id share their place in the mix and their shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.llm import decontamination, jaccard, mixing, sharding, toxicity
from tradeflow.llm.util import cut, ids_of, table

BLOCK_BYTES = 65_536


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with the order of their rows as a long: file after file as Spark's writer numbers them and row after row;
    where docs are not files, partition after partition."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and plan.children().size():
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return docs.withColumn(name, F.monotonically_increasing_id())
    file = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(_file, '{pattern}', 1) AS long)"), F.lit(0))
    d = docs.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = F.shiftleft(number(r"^part-([0-9]+)-"), 43).bitwiseOR(F.shiftleft(number(r"-c([0-9]+)[.]"), 33)).bitwiseOR(F.col("_row"))
    return d.withColumn(name, place).drop("_file", "_row")


def _beside(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """docs with columns of found by doc_id. Every row stays one row: rows of one id, or without one, get
    the same values."""
    one = found.groupBy(F.col("doc_id").alias("_id")).agg(*[F.min(c).alias(c) for c in columns])
    return docs.join(one, docs["doc_id"].eqNullSafe(one["_id"]), "left").drop("_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents predicted toxic go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component of near copies the document with the smallest id stays."""
    gone = ids_of(jaccard.linked(docs, counts=False).where("component_id <> doc_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that contain a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents in the order of the schedule, file after file and row after row."""
    order = mixing.mixed(docs, block_bytes=BLOCK_BYTES).select("doc_id", "position")
    return _beside(docs, order, "position").repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents with their shard and their slot in it; the slots follow the order of the mix."""
    placed = sharding.sharded(_numbered(docs, "_mix"), order="_mix").select("doc_id", "shard", "slot")
    return _beside(docs, placed, "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("benchmark", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]

#: The stages train, sample and walk at random, which SQL does not express; tests compare them
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("text_hash"), "shard", "slot")
