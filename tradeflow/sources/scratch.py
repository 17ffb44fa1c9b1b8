"""The shared folder for tables and checkpoints that outlive a job but not the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_runs: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application's own in the cluster's shared one, removed when the driver's JVM ends.

    Below a temporary folder only where none is set and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tradeflow-streams-"))
        shared = _own[0]
    run = f"{spark.sparkContext.applicationId}|{shared}"
    if run not in _runs:
        _runs[run] = f"{shared}/run-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_runs[run])
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return _runs[run]


def kept(d: DataFrame) -> DataFrame:
    """d written once as Parquet into the shared folder and read back: what uses it more than once does not work it out again,
    and a lost executor costs a reread."""
    path = f"{scratch(d.sparkSession)}/{uuid.uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)
