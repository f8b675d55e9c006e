"""A table dealt into hash buckets of its id, in which a merge rewrites only the buckets that it changes.

``root/data/<version>/bucket=<i>`` holds rows, ``root/manifest/<n>`` which version of each bucket is the current one. The
manifest with the greatest number that was written to its end counts; a merge that fails before leaves the one before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeatlas.sources.writers import upsert_by_id

MANIFEST = "bucket int, path string, buckets int, row_schema string"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, root: str) -> tuple[int, list]:
    """Number and rows of the current manifest: at most one row for each bucket."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    whole = [int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{n}/_SUCCESS"))]
    if not whole:
        raise ValueError(f"no bucket table at {root}")
    return max(whole), spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{max(whole)}").collect()


def _write(rows: DataFrame, root: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket under a new version; a bucket with many rows is several tasks and files. Returns the path of each bucket."""
    data = f"{root}/data/{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").parquet(data)
    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(data)
    files = path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
    return {int(n.removeprefix("bucket=")): f"{data}/{n}" for n in names if n.startswith("bucket=")}


def _publish(spark: SparkSession, root: str, number: int, paths: dict[int, str], buckets: int, schema: StructType) -> None:
    rows = [(b, p, buckets, schema.json()) for b, p in sorted(paths.items())] or [(None, None, buckets, schema.json())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/{number}")


def create_buckets(df: DataFrame, root: str, buckets: int) -> None:
    """Write a new table (columns ``id``, ``ord`` and any others) with so many buckets; ``bucket`` is no column name of its own."""
    if "bucket" in df.columns:
        raise ValueError("a column is named bucket")
    root = root.rstrip("/")
    _publish(df.sparkSession, root, 0, _write(df, root, buckets), buckets, df.schema)


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The current rows. A frame read earlier keeps the rows it had: files are never changed or removed here."""
    return _read(spark, _current(spark, root.rstrip("/"))[1])


def _read(spark: SparkSession, rows: list, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(rows[0].row_schema))
    paths = [r.path for r in rows if r.path is not None and (only is None or r.bucket in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_buckets(updates: DataFrame, root: str) -> set[int]:
    """``upsert_by_id`` of the updates into the table, and the numbers of the buckets that were written anew.

    Updates and old rows of the touched buckets only are read, joined and written; then a new manifest names them.
    New columns are null in old rows. Two merges at a time are not meant: the later one to publish fails, without effect.
    Rows without id stay, and those of the updates count as one id.
    """
    spark, root = updates.sparkSession, root.rstrip("/")
    number, rows = _current(spark, root)
    buckets = rows[0].buckets
    touched = {r.bucket for r in updates.select(_bucket(buckets).alias("bucket")).distinct().collect()}  # at most one for each bucket
    if not touched:
        return touched
    merged = upsert_by_id(_read(spark, rows, touched), updates)
    kept = {r.bucket: r.path for r in rows if r.path is not None}
    _publish(spark, root, number + 1, kept | _write(merged, root, buckets), buckets, merged.schema)
    return touched
