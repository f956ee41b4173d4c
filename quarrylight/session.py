"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2_000
SPLITS = "spark.sql.files.minPartitionNum"
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a local master gets a folder of its own; on a cluster that is an error, as executors would
    write where the driver can't read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='quarrylight-')}"
        where = _own_dirs[app]
    return where.rstrip("/")


def pin_splits(spark: SparkSession) -> None:
    """Fix how many splits small tables are cut into, unless the session does.

    Spark derives it from the cores of the moment, so a lost executor would change the partitions of a later
    scan of the same table, and with them row numbers that two plans of an operator must agree on.
    """
    if spark.conf.get(SPLITS, None) is None:
        conf = spark.sparkContext.getConf()
        asked = int(conf.get("spark.executor.instances", "0")) * int(conf.get("spark.executor.cores", "1"))
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or max(spark.sparkContext.defaultParallelism, asked)
        spark.conf.set(SPLITS, str(cores))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    pin_splits(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already; and ask for smaller Arrow
    batches than the default, as rows here are whole texts and vectors."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[1]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == root for p in known):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        where = shutil.make_archive(f"{tempfile.mkdtemp()}/quarrylight", "zip", root, "quarrylight")
        spark.sparkContext.addPyFile(where)
        _shipped.add(app)
