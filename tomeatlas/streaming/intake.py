"""Contributions, enrichment and new works as streams.

All sinks write per micro-batch under a key made of the batch number, so that a batch which runs
again after a failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomeatlas.functions.expr import strip
from tomeatlas.functions.geo import in_range
from tomeatlas.functions.text import norm_text
from tomeatlas.operators.dedup import dedup_first
from tomeatlas.operators.extract import infer
from tomeatlas.streaming.keyed import first_of_key

CONTRIBUTION = (
    "book_title string, author string, publish_year int, place_name string, coordinates array<double>, "
    "passage string, themes array<string>, language string"
)


def contribution_fault() -> Column:
    """First thing wrong with a contribution, null when it can be queued."""
    fault = F.lit(None).cast("string")
    checks = [(strip(c) == "", f"missing {c}") for c in ("book_title", "author", "place_name", "passage")]
    checks += [
        (F.col("themes").isNull(), "missing themes"),
        (F.coalesce(F.size("coordinates"), F.lit(-1)) != 2, "coordinates must be [longitude, latitude]"),
        (
            ~in_range(F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))),
            "coordinates out of range",
        ),
    ]
    for condition, message in reversed(checks):
        fault = F.when(condition, F.lit(message)).otherwise(fault)
    return fault


def validate_contribution(df: DataFrame) -> DataFrame:
    """Contributions with ``status`` pending or rejected and the ``fault`` of the latter."""
    checked = df.withColumn("fault", contribution_fault()).withColumn(
        "language", F.coalesce("language", F.lit("English"))
    )
    return checked.withColumn("status", F.when(F.col("fault").isNull(), F.lit("pending")).otherwise(F.lit("rejected")))


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def _before(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Key columns of what was written before a stream's first micro-batch, which may be running again; nothing yet if there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], columns)
    return spark.read.schema(f"{columns}, batch bigint").parquet(path).filter(F.col("batch") != 0).drop("batch")


def contribution_stream(source: DataFrame, accepted: str, dead_letter: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Queue valid contributions, put the others aside with their fault."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_contribution(batch).persist()
        _write_batch(checked.filter(F.col("status") == "pending").drop("fault"), accepted, batch_id)
        _write_batch(checked.filter(F.col("status") == "rejected"), dead_letter, batch_id)
        checked.unpersist()

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def enrichment_stream(
    source: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], results: str, checkpoint: str, mode: str = "strict", **trigger
) -> StreamingQuery:
    """Run the batch function over new rows (row_key, ...) and append results with their status.

    A row key is processed once, whether it comes again in the same micro-batch or ever after: state by key holds what was
    met, and starts from the results that are there already. The session of ``source`` needs a state store that can
    hold it (``keyed.state_session``).
    """
    key_type = dict(source.dtypes)["row_key"]
    done = _before(source.sparkSession, results, f"row_key {key_type}")

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(infer(batch, fn, mode), results, batch_id)

    return (
        first_of_key(source, ["row_key"], done).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_stream_results(df: DataFrame) -> DataFrame:
    """First result of every row key over all batches."""
    return dedup_first(df, ["row_key"], ["batch"])


def append_stream(
    source: DataFrame,
    corpus: str,
    checkpoint: str,
    columns: tuple[str, ...] = ("book_title", "author"),
    **trigger,
) -> StreamingQuery:
    """Append works that the corpus does not have yet, first arrival wins.

    State by key (the normalised columns) holds what was met. It starts from the corpus as it is before the first micro-batch;
    later ones look at the keys of their own rows only. There is no watermark: a row may arrive however late. The
    session of ``source`` needs a state store that can hold it (``keyed.state_session``).
    """
    names = [f"key{i}" for i in range(len(columns))]
    keyed = source.withColumns({n: norm_text(c) for n, c in zip(names, columns)})
    known = _before(source.sparkSession, corpus, ", ".join(f"{n} string" for n in names))

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, corpus, batch_id)

    return (
        first_of_key(keyed, names, known).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def seed_corpus(existing: DataFrame, corpus: str, columns: tuple[str, ...] = ("book_title", "author")) -> None:
    """Write the starting corpus in the layout that ``append_stream`` extends."""
    keyed = existing.withColumns({f"key{i}": norm_text(c) for i, c in enumerate(columns)})
    _write_batch(keyed, corpus, -1)
