"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a session that runs in one process may do without the setting; it gets a temporary folder, which goes when the
    process ends.
    """
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    if context.applicationId not in _local_roots:
        folder = _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tomeatlas-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table."""
    return f"{scratch_root(spark)}/tomeatlas/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives the loss of executors, and lets
    several branches share one computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
