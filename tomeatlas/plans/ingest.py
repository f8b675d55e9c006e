"""From catalogue, graph and sheet records to entries of the dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import items, text
from tomeatlas.functions.geo import is_null_island
from tomeatlas.functions.text import (
    catalogue_genres,
    catalogue_themes,
    norm_text,
    primary_language,
    slug,
    truncated,
)
from tomeatlas.functions.titles import is_likely_fiction
from tomeatlas.operators.dedup import dedup_first, new_rows, union_entries
from tomeatlas.operators.joins import country_regions, merge_passages, with_region
from tomeatlas.operators.search import backfill_candidates
from tomeatlas.operators.spatial import nearest_seed_city
from tomeatlas.sources.parsers import parse_contribution_sheet

FAR_KM = 500.0  # fixed value: beyond this an entry is flagged


def seed_cities(spark: SparkSession, seeds: Sequence[Sequence[str]] = vocab.SEED_CITIES) -> DataFrame:
    rows = [(i, r[0], float(r[1]), float(r[2]), r[3], r[4]) for i, r in enumerate(seeds)]
    return spark.createDataFrame(rows, "city_ord bigint, city string, lon double, lat double, region string, country string")


def known_places(spark: SparkSession, rows: Sequence[Sequence[str]] = vocab.KNOWN_PLACES) -> DataFrame:
    data = [(i, r[0], float(r[1]), float(r[2])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord bigint, name string, lon double, lat double")


def country_region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(country_regions(), "country string, region string")


def search_names(
    spark: SparkSession, cities: DataFrame, aliases: Mapping[str, Sequence[str]] = vocab.CATALOGUE_ALIASES
) -> DataFrame:
    """(search_name, name_ord, city, ...): every city under its own name and its other names."""
    table = spark.createDataFrame(
        [(other, i + 1, city) for city, others in aliases.items() for i, other in enumerate(others)], "search_name string, name_ord int, city string"
    )
    own = cities.withColumns({"search_name": F.col("city"), "name_ord": F.lit(0)})
    return own.unionByName(cities.join(table, "city"))


def catalogue_to_entries(books: DataFrame) -> DataFrame:
    """Entries from book rows joined with their city (city, lon, lat, region)."""
    year = F.coalesce("first_publish_year", F.lit(0))
    key = F.substring_index("work_key", "/", -1)
    city_slug = F.replace(F.lower("city"), F.lit(" "), F.lit("-"))
    author = F.when(F.size(items("authors")) > 0, F.array_join("authors", ", ")).otherwise(F.lit("Unknown"))
    description = F.col("description") if "description" in books.columns else F.lit(None).cast("string")
    return books.select(
        "ord",
        F.concat(F.lit("ol-"), key, F.lit("-"), city_slug).alias("id"),
        F.col("title").alias("book_title"), author.alias("author"), year.alias("publish_year"),
        F.col("city").alias("place_name"), "lon", "lat",
        F.lit("real").alias("place_type"), F.lit("primary").alias("setting_type"),
        F.when(year != 0, F.concat(year.cast("string"), F.lit("s"))).otherwise(F.lit("")).alias("narrative_era"),
        truncated(description, 300, "...").alias("passage"),
        F.lit(0.0).alias("polarity"), items(F.lit(None)).alias("emotions"),
        catalogue_themes("subjects").alias("themes"),
        primary_language("languages").alias("language"),
        catalogue_genres("subjects").alias("genres"),
        "region", F.col("work_key").alias("open_library_key"), F.col("cover_url"), F.lit("openlibrary").alias("source"),
    )


def run_catalogue_ingest(books: DataFrame, names: DataFrame, works: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entries from catalogue answers (search_name, position, book columns).

    A work counts once, for the first city and name that found it; what is no fiction is left out
    after that, so a later city does not get it either. ``works`` adds descriptions by work key.
    """
    order = ["city_ord", "name_ord", "position"]
    found = books.filter(F.col("work_key") != "").join(names, "search_name")
    first = dedup_first(found, ["work_key"], order)
    if works is not None:
        described = works.groupBy("work_key").agg(F.max("description").alias("description"))
        first = first.join(described, "work_key", "left")
    named = ~F.lower(text("title")).isin("untitled", "")
    kept = first.filter(named & is_likely_fiction())
    # list order: city, name, position
    return {"data": catalogue_to_entries(kept.withColumn("ord", F.struct(*order))), "removed": first.filter(~(named & is_likely_fiction()))}


def narrative_to_entries(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Entries from graph rows; points at null island are left out.

    The nearest seed city gives distance, far flag, and region or country where they are unknown.
    """
    near = df.filter(~is_null_island("longitude", "latitude")).withColumn(
        "_near", nearest_seed_city("longitude", "latitude")
    )
    placed = with_region(
        near.withColumns(
            {"country": text("country_label"), "nearest_region": F.col("_near.region"), "nearest_country": F.col("_near.country")}
        ),
        regions,
    )
    book, place = text("book_qid"), text("place_qid")
    place_name = F.coalesce(F.nullif("place_label", F.lit("")), F.lit("Unknown Place"))
    year = F.coalesce("publication_year", F.lit(0))
    far = F.col("_near.distance_km") > FAR_KM
    return placed.select(
        "ord",
        F.concat(
            F.lit("wd-"), F.coalesce(F.nullif(book, F.lit("")), F.lit("unknown-book")), F.lit("-"),
            F.when(place == "", slug(place_name)).otherwise(place),
        ).alias("id"),
        F.coalesce(F.nullif("book_label", F.lit("")), F.lit("Unknown Title")).alias("book_title"),
        F.coalesce(F.nullif("author_label", F.lit("")), F.lit("Unknown")).alias("author"),
        year.alias("publish_year"), place_name.alias("place_name"),
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        F.lit("real").alias("place_type"), F.lit("primary").alias("setting_type"),
        F.when(year != 0, F.concat(year.cast("string"), F.lit("s"))).otherwise(F.lit("")).alias("narrative_era"),
        F.lit("").alias("passage"), F.lit(0.0).alias("polarity"),
        items(F.lit(None)).alias("emotions"), items(F.lit(None)).alias("themes"),
        F.coalesce(F.nullif("language_label", F.lit("")), F.lit("Unknown")).alias("language"),
        items("genre_labels").alias("genres"), "region", "country", F.lit("wikidata").alias("source"),
        book.alias("wikidata_book_qid"), place.alias("wikidata_place_qid"),
        F.when(far, F.array(F.lit("far_from_known_city"))).otherwise(items(F.lit(None))).alias("qa_flags"),
        F.col("_near.city").alias("nearest_known_city"),
        F.round("_near.distance_km", 2).alias("nearest_known_city_distance_km"),
        "region_inferred",
    )


def expansion_status(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Graph rows with ``status``: deduped, rejected (null island) or new.

    A work known to the dataset, or accepted earlier in the list, is a duplicate; a rejected row
    does not make later rows of its work duplicates.
    """
    keys = {"title_key": norm_text("book_label"), "author_key": norm_text(F.coalesce(F.nullif("author_label", F.lit("")), F.lit("Unknown")))}
    rows = incoming.withColumns({**keys, "_null": is_null_island("longitude", "latitude")})
    known = (
        existing.select(norm_text("book_title").alias("title_key"), norm_text("author").alias("author_key"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    first = rows.filter(~F.col("_null")).groupBy("title_key", "author_key").agg(F.min("ord").alias("_first"))
    joined = rows.join(known, ["title_key", "author_key"], "left").join(first, ["title_key", "author_key"], "left")
    status = (
        F.when(F.col("_known"), F.lit("deduped"))
        .when(F.col("ord") > F.col("_first"), F.lit("deduped"))
        .when(F.col("_null"), F.lit("rejected"))
        .otherwise(F.lit("new"))
    )
    return joined.withColumn("status", status).drop("_null", "_known", "_first")


def expansion_stats(existing: DataFrame, status: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: existing, fetched, deduped, rejected, flagged far, new."""
    counts = status.agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("status") == "deduped").alias("deduped"),
        F.count_if(F.col("status") == "rejected").alias("rejected_null_island"),
        F.count_if(F.col("status") == "new").alias("new_entries"),
    )
    return counts.withColumns(
        {
            "existing": existing.agg(F.count("*")).scalar(),
            "flagged_far": entries.agg(F.count_if(F.array_contains("qa_flags", "far_from_known_city"))).scalar(),
        }
    )


def run_expansion(existing: DataFrame, incoming: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    status = expansion_status(existing, incoming)
    fresh = narrative_to_entries(status.filter(F.col("status") == "new"), regions)
    return {
        "data": union_entries(existing, fresh),
        "new": fresh,
        "removed": status.filter(F.col("status") != "new"),
        "report": expansion_stats(existing, status, fresh),
    }


def run_sheet_merge(existing: DataFrame, sheet: DataFrame, gazetteer: DataFrame) -> dict[str, DataFrame]:
    """Dataset with the sheet's entries whose lower-case (title, place) is new."""
    entries, unresolved = parse_contribution_sheet(sheet, gazetteer)
    keys = {"_k0": F.lower("book_title"), "_k1": F.lower("place_name")}
    fresh = new_rows(existing.withColumns(keys), entries.withColumns(keys), ["_k0", "_k1"]).drop("_k0", "_k1")
    return {"data": union_entries(existing, fresh), "new": fresh, "unresolved": unresolved}


def run_backfill(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], min_length: int = 60) -> dict[str, DataFrame]:
    """Rows without a passage, and the base merged with the passages found for them."""
    merged = merge_passages(base, sources, min_length)
    report = merged.groupBy("merge_status").agg(F.count("*").alias("entries"))
    return {"candidates": backfill_candidates(base, "description"), "data": merged, "report": report}
