"""Readers: place datasets, releases, database tables, full texts, result and key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeatlas.functions.expr import strip, text
from tomeatlas.schema import CAMEL, PLACE, to_snake

_ENVELOPE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("places", T.ArrayType(CAMEL)),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("row_key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("book_title", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField(
            "result",
            T.StructType(
                [
                    T.StructField("polarity", T.DoubleType()),
                    T.StructField("dominant_emotions", T.ArrayType(T.StringType())),
                    T.StructField("themes", T.ArrayType(T.StringType())),
                    T.StructField("literary_mood", T.StringType()),
                ]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """Places of JSON envelopes held as text, with their position in the list as ``ord``."""
    parsed = df.select(F.from_json(column, _ENVELOPE).alias("e"))
    rows = parsed.select(F.posexplode("e.places").alias("ord", "p")).select(F.col("ord").cast("bigint"), "p.*")
    return to_snake(rows, keep=("ord",))


def read_places(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Place dataset as flat rows.

    ``parquet`` is what ``write_places`` writes and keeps ``ord``; ``jsonl`` has one camelCase
    record per line with an ``ord`` field; ``json`` is the envelope, one document per file, which
    cannot be split and is meant for import only.
    """
    if fmt == "parquet":
        return spark.read.schema(PLACE).parquet(path)
    if fmt == "jsonl":
        schema = T.StructType([T.StructField("ord", T.LongType()), *CAMEL.fields])
        return to_snake(spark.read.schema(schema).json(path), keep=("ord",))
    if fmt == "json":
        rows = (
            spark.read.schema(_ENVELOPE)
            .json(path, multiLine=True)
            .select(F.posexplode("places").alias("ord", "p"))
            .select(F.col("ord").cast("bigint"), "p.*")
        )
        return to_snake(rows, keep=("ord",))
    raise ValueError(f"unknown format: {fmt}")


def latest_release(df: DataFrame) -> DataFrame:
    """Rows of the highest release; with ``release`` as partition column only its files are read."""
    newest = df.agg(F.max("release")).scalar()
    return df.filter(F.col("release") == newest)


def read_release(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Pinned or latest release of a dataset partitioned by ``release``.

    The latest one is chosen by the folder names, so the files of others are not touched.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if version is None:
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        version = max(s.getPath().getName().removeprefix("release=") for s in found if s.getPath().getName().startswith("release="))
    schema = T.StructType([*PLACE.fields, T.StructField("release", T.StringType())])
    return spark.read.schema(schema).option("basePath", root).parquet(f"{root.rstrip('/')}/release={version}")


def read_jdbc_partitioned(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """Database table read by ranges of a numeric column, in parallel instead of page by page."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options
    )


def read_fulltext(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """(book_id, text) of one text file per book; the id is the file name without its ending, or that of a folder ``book_id=...``.

    With ``bundled``, files hold many books each, as ``write_fulltext`` writes them: listing and opening a file for every
    book takes longer than reading them when there are hundreds of thousands. Large bundles are read in parts.
    """
    if bundled:
        return _read_bundles(spark, path)
    files = spark.read.text(path, wholetext=True)
    if "book_id" in files.columns:
        return files.select(F.col("book_id").cast("string").alias("book_id"), F.col("value").alias("text"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(name.alias("book_id"), F.col("value").alias("text"))


_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def write_fulltext(texts: DataFrame, path: str) -> None:
    """Full texts (book_id, text) as bundles of many books for ``read_fulltext``: one line each, with line ends, tabs and backslashes escaped."""
    line = text("text")
    for plain, escaped in _ESCAPES:
        line = F.replace(line, F.lit(plain), F.lit(escaped))
    texts.select(F.concat(text(F.col("book_id").cast("string")), F.lit("\t"), line).alias("value")).write.text(path)


def _read_bundles(spark: SparkSession, path: str) -> DataFrame:
    def plain(part: Column) -> Column:
        for sign, escaped in _ESCAPES[1:]:
            part = F.replace(part, F.lit(escaped), F.lit(sign))
        return part

    value, tab = F.col("value"), F.instr("value", "\t")
    # a doubled backslash stays apart from the sign behind it: what lies between two of them is unescaped
    unescaped = F.array_join(F.transform(F.split(F.substr(value, tab + 1), r"\\\\"), plain), "\\")
    return spark.read.text(path, lineSep="\n").select(F.nullif(F.left(value, tab - 1), F.lit("")).alias("book_id"), unescaped.alias("text"))


def paragraphs(texts: DataFrame, key: str = "book_id") -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n\n")).alias("paragraph", "text"))


def read_enrichment_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines; unreadable lines are kept with status ``corrupt``."""
    df = spark.read.schema(RESULT).json(path, columnNameOfCorruptRecord="_corrupt")
    broken = F.col("_corrupt").isNotNull()
    return df.withColumn("status", F.when(broken, F.lit("corrupt")).otherwise(F.col("status")))


def accepted_results(results: DataFrame) -> DataFrame:
    """(row_key, polarity, emotions, themes, literary_mood) of the accepted result lines."""
    return results.filter(F.col("status") == "ok").select(
        "row_key", "result.polarity", F.col("result.dominant_emotions").alias("emotions"), "result.themes",
        "result.literary_mood",
    )


def one_line(c: str) -> Column:
    """A field without line ends: backslashes are doubled, line ends written as \\n and \\r."""
    out = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unfolded(c: str) -> Column:
    """The field that ``one_line`` wrote."""
    out = F.replace(F.col(c), F.lit("\\\\"), F.lit("\x00"))
    out = F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def read_batch_csv(spark: SparkSession, path: str, start: int = 0, limit: int = 0) -> DataFrame:
    """Batch input with a header and an ``ord`` column; ``start`` and ``limit`` cut a slice of it.

    A record is one line, with line ends in fields written as \\n (see ``one_line``), so large files are split.
    """
    schema = T.StructType(
        [T.StructField("ord", T.LongType())]
        + [
            T.StructField(c, T.StringType())
            for c in (
                "row_key", "id", "book_title", "author", "publish_year", "place_name", "region", "language",
                "genres_csv", "narrative_era", "passage_or_summary",
            )
        ]
    )
    df = spark.read.csv(path, schema=schema, header=True, escape='"')
    df = df.withColumns({c: unfolded(c) for c, kind in df.dtypes if kind == "string"})
    if start > 0:
        df = df.filter(F.col("ord") >= start)
    if limit > 0:
        df = df.filter(F.col("ord") < start + limit)
    return df


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty lines of a key file."""
    return spark.read.text(path).select(strip("value").alias("key")).filter(F.col("key") != "").distinct()
