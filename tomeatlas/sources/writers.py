"""Sinks: datasets with statistics, GeoJSON, CSV, slim index, detail documents, hero subset, upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tomeatlas.functions.expr import items, strip, text
from tomeatlas.functions.quality import tier_or_strict
from tomeatlas.functions.text import same_as, url_key
from tomeatlas.operators.dedup import dedup_first
from tomeatlas.schema import conform, ensure, to_camel


def write_places(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> dict:
    """Write the dataset and return its statistics, which are observed during the write itself."""
    seen = Observation("places")
    out = conform(df).observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(strip("passage") != "").alias("with_passage"),
        F.count_if(F.size(items("themes")) > 0).alias("with_themes"),
    )
    if fmt == "jsonl":
        out = to_camel(out, keep=("ord",))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format("json" if fmt == "jsonl" else fmt).save(path)
    return dict(seen.get)


def to_geojson(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per line; rows without a point are left out."""
    located = df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    camel = to_camel(located)
    properties = F.struct(*[c for c in camel.columns if c != "coordinates"])
    geometry = F.struct(F.lit("Point").alias("type"), F.col("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), geometry.alias("geometry"), properties.alias("properties"))
    return camel.select("id", F.to_json(feature).alias("feature"))


def to_export_csv(df: DataFrame) -> DataFrame:
    """The twenty export columns, lists joined by "|", coordinates blank when missing."""
    df = ensure(
        df, "place_type", "setting_type", "narrative_era", "wikidata_book_id", "wikidata_place_id",
        "open_library_key", "source",
    )
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()

    def number(c: str) -> Column:
        return F.when(located, F.col(c).cast("string")).otherwise(F.lit(""))

    def joined(c: str) -> Column:
        return F.array_join(items(c), "|")

    columns = {
        "id": text("id"), "bookTitle": text("book_title"), "author": text("author"),
        "publishYear": text(F.col("publish_year").cast("string")), "placeName": text("place_name"),
        "longitude": number("lon"), "latitude": number("lat"), "placeType": text("place_type"),
        "settingType": text("setting_type"), "narrativeEra": text("narrative_era"), "language": text("language"),
        "region": text("region"), "genres": joined("genres"), "polarity": F.coalesce("polarity", F.lit(0.0)),
        "dominantEmotions": joined("emotions"), "themes": joined("themes"),
        "wikidataBookId": text("wikidata_book_id"), "wikidataPlaceId": text("wikidata_place_id"),
        "openLibraryKey": text("open_library_key"), "source": text("source"),
    }
    return df.select(*[v.alias(k) for k, v in columns.items()])


def write_export_csv(df: DataFrame, path: str) -> None:
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    to_export_csv(df).write.mode("overwrite").options(**exact).csv(path)


def slim_index(df: DataFrame) -> DataFrame:
    """The fourteen fields that maps and result lists need."""
    df = ensure(df, "quality_tier", "place_granularity", "cover_url", "passage_type")
    return df.select(
        text("id").alias("id"), text("book_title").alias("bookTitle"), text("author").alias("author"),
        text("place_name").alias("placeName"), F.array("lon", "lat").alias("coordinates"), text("region").alias("region"),
        F.coalesce("polarity", F.lit(0.0)).alias("sp"), tier_or_strict().alias("qt"),
        F.coalesce("place_granularity", F.lit("city")).alias("pg"), F.coalesce("publish_year", F.lit(0)).alias("publishYear"),
        text("cover_url").alias("coverUrl"), F.coalesce("language", F.lit("English")).alias("language"),
        F.slice(items("genres"), 1, 3).alias("g"), F.slice(items("themes"), 1, 5).alias("t"),
    )


def detail_documents(df: DataFrame) -> DataFrame:
    """(key, id, document) with schema.org fields; a keyed table rather than a file per row."""
    df = ensure(df, "wikidata_book_id", "open_library_url", "open_library_key").filter(text("id") != "")
    camel = to_camel(df.withColumn("_point", F.col("lon").isNotNull() & F.col("lat").isNotNull()), keep=("_point",))
    geo = F.struct(
        F.lit("GeoCoordinates").alias("@type"), F.get("coordinates", F.lit(0)).alias("longitude"),
        F.get("coordinates", F.lit(1)).alias("latitude"),
    )
    spot = F.struct(F.lit("Place").alias("@type"), F.col("placeName").alias("name"), geo.alias("geo"))
    here = F.col("_point")
    links = same_as("wikidataBookId", "openLibraryUrl", "openLibraryKey")
    document = F.struct(
        *[c for c in camel.columns if c != "_point"],
        F.when(here, F.lit("https://schema.org")).alias("@context"),
        F.when(here, F.lit("Book")).alias("@type"),
        F.when(here, spot).alias("spatialCoverage"),
        F.when(here, spot).alias("contentLocation"),
        F.when(F.size(links) > 0, links).alias("sameAs"),
    )
    return camel.select(url_key("id").alias("key"), "id", F.to_json(document).alias("document"))


def with_read_links(df: DataFrame) -> DataFrame:
    """Work page for catalogue rows, a search link for rows without one."""
    from tomeatlas.functions.text import search_link, work_url

    df = ensure(df, "open_library_key", "open_library_url", "goodreads_url")
    has_key, has_url = text("open_library_key") != "", text("open_library_url") != ""
    searchable = ~has_key & ~has_url & (text("book_title") != "")
    return df.withColumns(
        {
            "open_library_url": F.when(has_key, work_url("open_library_key")).otherwise(F.col("open_library_url")),
            "goodreads_url": F.when(searchable, search_link("book_title", "author")).otherwise(F.col("goodreads_url")),
        }
    )


def hero_score() -> Column:
    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (
        points(F.size(items("emotions")) >= 3, 2)
        + points(F.size(items("themes")) >= 2, 2)
        + points(F.coalesce("polarity", F.lit(0.0)) != 0, 1)
        + points(F.length(text("passage")) > 50, 2)
        + points(text("cover_url") != "", 1)
    )


def hero_subset(df: DataFrame, n: int) -> DataFrame:
    """The n richest entries, list order among equals."""
    df = ensure(df, "cover_url").withColumn("hero_score", hero_score())
    return df.orderBy(F.col("hero_score").desc(), "ord").limit(n)


def common_themes(df: DataFrame, min_n: int = 2) -> DataFrame:
    themes = df.select(F.explode(items("themes")).alias("theme"))
    return themes.groupBy("theme").agg(F.count("*").alias("entries")).filter(F.col("entries") >= min_n)


def upsert_by_id(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Target rows not updated, and the last row of each updated id."""
    latest = dedup_first(updates, ["id"], [F.col("ord").desc()])
    kept = target.join(latest.select("id"), "id", "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def write_upsert(target: DataFrame, updates: DataFrame, root: str) -> str:
    """Write the merged table beside the old one and return its path for the caller to switch to."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    upsert_by_id(target, updates).write.parquet(path)
    return path


