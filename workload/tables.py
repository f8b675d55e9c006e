"""The tables of a folder, and the place view over them in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeatlas.functions.expr import strings

THEMES = [
    "labor_exploitation", "war_trauma", "family_conflict", "urban_precarity", "caste_oppression",
    "migration_displacement", "prison_resistance", "identity", "colonial_violence", "village_memory",
    "crime_alienation", "marriage_betrayal",
]
EMOTIONS = ["grief", "hope", "fury", "wistfulness", "dread", "tenderness", "solidarity"]
GENRES = ["mystery", "crime", "romance", "historical fiction", "poetry", "satire", "thriller", "literary fiction"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _labels(values: list[str], count: int, step: int) -> Column:
    doc = F.col("doc_id")
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < doc % count),
        lambda i: F.element_at(strings(values), ((doc + i * step) % len(values)).cast("int") + 1),
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    """One place row per document: names from nation and region, coordinates and labels from the id."""
    doc = F.col("doc_id")
    docs = table(spark, folder, "documents")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    labels = table(spark, folder, "labels")
    joined = (
        docs.withColumn("n_nationkey", (doc % 25).cast("int"))
        .join(nation, "n_nationkey")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(labels, "doc_id", "left")
    )
    composite = F.concat(F.col("n_name"), F.lit(" and NATION_"), ((doc + 7) % 25).cast("string"))
    return joined.select(
        doc.alias("ord"),
        F.concat(F.lit("doc-"), doc.cast("string")).alias("id"),
        F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("book_title"),
        F.col("source").alias("author"),
        F.when(doc % 17 == 0, F.lit(0)).otherwise(1850 + doc % 175).cast("int").alias("publish_year"),
        F.when(doc % 11 == 0, composite).otherwise(F.col("n_name")).alias("place_name"),
        F.col("r_name").alias("region"),
        F.col("lang").alias("language"),
        ((doc * 7919 % 36000) / F.lit(100.0) - 180).alias("lon"),
        ((doc * 104729 % 17000) / F.lit(100.0) - 85).alias("lat"),
        F.when(doc % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("passage"),
        ((F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0))).cast("double") * 0.5).alias("polarity"),
        _labels(THEMES, 5, 5).alias("themes"),
        _labels(EMOTIONS, 4, 2).alias("emotions"),
        _labels(GENRES, 3, 3).alias("genres"),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_labels(values: list[str], count: int, step: int) -> str:
    return (
        f"list_transform(range(0, d.doc_id % {count}), "
        f"lambda i: {sql_list(values)}[cast((d.doc_id + i * {step}) % {len(values)} as int) + 1])"
    )


PLACES_SQL = f"""
select d.doc_id as ord, 'doc-' || d.doc_id as id,
 array_to_string(list_slice(string_split(d.text, ' '), 1, 3), ' ') as book_title, d.source as author,
 cast(case when d.doc_id % 17 = 0 then 0 else 1850 + d.doc_id % 175 end as int) as publish_year,
 case when d.doc_id % 11 = 0 then n.n_name || ' and NATION_' || ((d.doc_id + 7) % 25) else n.n_name end as place_name,
 r.r_name as region, d.lang as language, (d.doc_id * 7919 % 36000) / 100.0::double - 180 as lon,
 (d.doc_id * 104729 % 17000) / 100.0::double - 85 as lat,
 case when d.doc_id % 13 = 0 then '' else d.text end as passage,
 cast(coalesce(l.quality, 0) - coalesce(l.toxic, 0) as double) * 0.5 as polarity,
 {_sql_labels(THEMES, 5, 5)} as themes,
 {_sql_labels(EMOTIONS, 4, 2)} as emotions,
 {_sql_labels(GENRES, 3, 3)} as genres
 from documents d join nation n on n.n_nationkey = d.doc_id % 25 join region r on r.r_regionkey = n.n_regionkey
 left join labels l on l.doc_id = d.doc_id
"""


def joined(c: str | Column) -> Column:
    """List column as text, for results."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, "|")


# ---- SQL snippets ----


def norm(x: str) -> str:
    return rf"trim(lower(regexp_replace(coalesce({x}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))"


_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '^{_BLANKS}', ''), '{_BLANKS}$', '')"


def has_any(x: str, words: list[str]) -> str:
    return f"(len(list_filter({sql_list(words)}, lambda w: contains({x}, w))) > 0)"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_map(pairs: list[tuple[str, str]]) -> str:
    p = dict(pairs)
    return f"map({sql_list(list(p))}, {sql_list(list(p.values()))})"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, '_'), lambda t: t <> '')"
