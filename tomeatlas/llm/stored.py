"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeatlas.plans.scratch import scratch_path


class Stored:
    """Tables that one operator writes between its stages.

    A written table cuts the lineage: a lost executor only makes readers read again. Tables that a later
    one replaces are removed with ``drop``; those that the returned frame reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def path(self, what: str) -> str:
        return scratch_path(self.spark, f"{self.name}-{what}")

    def save(self, df: DataFrame, what: str) -> DataFrame:
        path = self.path(what)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        _, path = self.paths.pop(id(df))
        remove(self.spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows, and about ``size`` bytes, at a time to Python; the settings are put back afterwards."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    was = {name: spark.conf.get(name) for name in names[: 1 if size is None else 2]}
    for (name, before), most in zip(was.items(), (rows, size)):
        now = int(before) if before.lstrip("-").isdigit() else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a side of numbers, a few bytes each, that a join broadcasts at most; a larger side is shuffled.
BROADCAST_ROWS = 1_000_000


def few(numbers: DataFrame, most: int | None = None) -> DataFrame:
    """A side of a join that has a few numbers in each row: to be broadcast behind a check of its size, else shuffled."""
    return F.broadcast(numbers) if numbers.count() <= (BROADCAST_ROWS if most is None else most) else numbers.hint("merge")


def by_number(rows: DataFrame, numbers: DataFrame, how: str, number: str = "nth") -> DataFrame:
    """Join on a row number that no two rows share, so that no key is frequent if both sides have to be shuffled."""
    return rows.join(few(numbers), number, how)


#: Stands for a null doc_id in joins.
NO_ID = -(2**63)


def with_empty_text(docs: DataFrame) -> DataFrame:
    """The two columns that an operator reads, whatever else the input has; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed_text(docs: DataFrame) -> DataFrame:
    """Columns doc, row, text: doc_id (NO_ID for null) and a hash of the text, which tell rows apart in joins."""
    plain = with_empty_text(docs)
    return plain.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")
