"""Equi-join based enrichment of places: dimensions, passages, labels, genres, geocoding, splits.

Small sides are left to Spark's own size-checked broadcast; the other side of such a decision is a
shuffle join with adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import items, strip, text
from tomeatlas.functions.quality import place_granularity, with_geolocation_fields
from tomeatlas.functions.text import (
    composite_parts,
    historical_name,
    is_composite,
    is_qid,
    norm_text,
    sheet_city,
    subject_genres,
)
from tomeatlas.schema import ensure


def denormalise(book_places: DataFrame, books: DataFrame, authors: DataFrame, places: DataFrame) -> DataFrame:
    """book_places with its book, author and place."""
    return (
        book_places.join(books, "book_id").join(authors, "author_id").join(places, "place_id")
    )


def merge_passages(
    base: DataFrame, sources: Sequence[tuple[str, DataFrame]], min_length: int = 60
) -> DataFrame:
    """Base rows with the longest passage found for their id in the sources (id, passage, ord).

    Sources are given in order with the tag their passages get; shorter texts than ``min_length``
    count nowhere and are cleared in the base. ``merge_status`` tells new, upgraded, replaced, kept.
    """
    base = ensure(base, "passage_source")
    found = None
    for i, (tag, df) in enumerate(sources):
        part = df.select("id", strip("passage").alias("text"), F.lit(tag).alias("tag"), F.lit(i).alias("src"), "ord")
        found = part if found is None else found.unionByName(part)
    best = (
        found.filter((F.length("text") >= min_length) & (text("id") != ""))
        .groupBy("id")
        .agg(
            F.max_by(
                F.struct("text", "tag"), F.struct(F.length("text"), -F.col("src"), -F.col("ord"))
            ).alias("best")
        )
    )
    old = strip("passage")
    cleared = F.when((old != "") & (F.length(old) < min_length), F.lit("")).otherwise(F.col("passage"))
    base = base.withColumn("passage", cleared)
    status = (
        F.when(F.col("best").isNull(), F.lit("kept"))
        .when(old == "", F.lit("new"))
        .when(F.length("best.text") > F.length(old), F.lit("upgraded"))
        .otherwise(F.lit("replaced"))
    )
    merged = base.join(best, "id", "left").withColumn("merge_status", status)
    return merged.withColumns(
        {
            "passage": F.coalesce("best.text", "passage"),
            "passage_source": F.coalesce("best.tag", "passage_source"),
        }
    ).select(*base.columns, "merge_status")


def country_regions(
    seeds: Sequence[Sequence[str]] = vocab.SEED_CITIES,
    regions: Mapping[str, str] = vocab.COUNTRY_REGION,
) -> list[tuple[str, str]]:
    """Region of every known country, the country table before the seed cities."""
    known = dict(regions)
    for _, _, _, region, country in seeds:
        known.setdefault(country, region)
    return list(known.items())


def with_region(
    df: DataFrame, regions: DataFrame, fallback_region: str = "nearest_region", fallback_country: str = "nearest_country"
) -> DataFrame:
    """Region of the row's country from a (country, region) table, else of the nearest city."""
    country = strip("country")
    table = regions.select(F.col("country").alias("_country"), F.col("region").alias("_region"))
    joined = df.withColumn("_key", country).join(table, F.col("_key") == F.col("_country"), "left")
    inferred = F.col("_region").isNull() | (F.col("_key") == "")
    return joined.withColumns(
        {
            "region": F.coalesce("_region", F.nullif(fallback_region, F.lit("")), F.lit("Unknown")),
            "country": F.coalesce(
                F.nullif("_key", F.lit("")), F.nullif(fallback_country, F.lit("")), F.lit("Unknown")
            ),
            "region_inferred": inferred,
        }
    ).drop("_key", "_country", "_region")


# ---- geocoding against a gazetteer (name, lon, lat, ord) ----

def _substrings(c: Column, lengths: Column) -> Column:
    """Distinct substrings of a short label with one of the given lengths."""
    n = F.length(c)
    fitting = F.filter(lengths, lambda k: k <= n)
    return F.array_distinct(
        F.flatten(
            F.transform(
                fitting,
                lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(c, i, k)),
            )
        )
    )


def geocode(df: DataFrame, gazetteer: DataFrame, column: str = "city") -> DataFrame:
    """Display name and coordinates of free-form city cells; coordinates null when unresolved.

    Exact names win (display form, query form, raw text); otherwise the first gazetteer name, in
    its own order, that occurs inside the raw text. Only distinct cells are resolved, and
    containment is an equi-join on the cell's substrings.
    """
    cells = df.select(F.col(column).alias("_cell")).distinct().withColumn("_form", sheet_city("_cell"))
    gaz = gazetteer.select(
        F.col("name").alias("_name"),
        F.struct("lon", "lat").alias("_at"),
        F.col("ord").alias("_gord"),
    )
    candidates = cells.select(
        "_cell", F.posexplode(F.array("_form.display", "_form.query", strip("_cell"))).alias("_prio", "_name")
    )
    exact = (
        candidates.join(gaz, "_name")
        .groupBy("_cell")
        .agg(F.min_by("_at", F.struct("_prio", "_gord")).alias("_at"))
    )
    lengths = gaz.agg(F.collect_set(F.length("_name"))).scalar()
    parts = (
        cells.join(exact, "_cell", "left_anti")
        .withColumns({"_low": F.lower(strip("_cell")), "_lengths": lengths})
        .select("_cell", F.explode(_substrings(F.col("_low"), F.col("_lengths"))).alias("_part"))
    )
    inside = (
        parts.join(gaz.withColumn("_part", F.lower("_name")), "_part")
        .groupBy("_cell")
        .agg(F.min_by("_at", "_gord").alias("_at"))
    )
    resolved = exact.unionByName(inside)
    places = cells.join(resolved, "_cell", "left").select(
        "_cell",
        F.col("_form.display").alias("display_city"),
        F.col("_at.lon").alias("lon"),
        F.col("_at.lat").alias("lat"),
    )
    base = df.drop("display_city", "lon", "lat")
    return base.join(places, base[column].eqNullSafe(places["_cell"]), "left").drop("_cell")


def geocode_names(names: DataFrame, gazetteer: DataFrame, column: str = "name") -> DataFrame:
    """Coordinates of extracted place names, former names looked up under the present one first."""
    modern = historical_name(column)
    wanted = names.withColumns({"_modern": modern, "_given": F.lower(strip(column))}).withColumn(
        "_tries", F.array_distinct(F.array(F.lower(F.coalesce("_modern", "_given")), F.col("_given")))
    )
    tries = wanted.select(F.col("_given"), F.posexplode("_tries").alias("_prio", "_try")).distinct()
    gaz = gazetteer.select(
        F.lower(strip("name")).alias("_try"), F.struct("lon", "lat", "country").alias("_at"), F.col("ord").alias("_gord")
    )
    hits = tries.join(gaz, "_try").groupBy("_given").agg(F.min_by("_at", F.struct("_prio", "_gord")).alias("_at"))
    historical = F.col("_modern").isNotNull()
    return wanted.join(hits, "_given").select(
        *names.columns,
        F.col("_at.lon").alias("lon"),
        F.col("_at.lat").alias("lat"),
        F.col("_at.country").alias("country"),
        F.when(historical, F.lit(0.7)).otherwise(F.lit(0.8)).alias("geo_confidence"),
        historical.alias("is_historical"),
        F.col("_modern").alias("modern_name"),
    )


# ---- labels, genres, enrichment results ----

def resolve_labels(df: DataFrame, labels: DataFrame, drop: bool = False) -> DataFrame:
    """Replace identifier titles of graph rows by the label of the (qid, label) table."""
    df = ensure(df, "wikidata_book_qid", "source")
    open_title = (text("source") == "wikidata") & is_qid("book_title")
    qid = F.when(
        open_title, F.coalesce(F.nullif(strip("wikidata_book_qid"), F.lit("")), strip("book_title"))
    )
    table = labels.select(F.col("qid").alias("_qid"), F.nullif("label", F.lit("")).alias("_label"))
    table = table.groupBy("_qid").agg(F.max("_label").alias("_label"))  # one label for a repeated identifier
    out = df.withColumn("_want", qid).join(table, F.col("_want") == F.col("_qid"), "left")
    out = out.withColumn("book_title", F.coalesce("_label", "book_title")).select(*df.columns)
    return out.filter(~open_title) if drop else out


def merge_genres(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add genres found in the (open_library_key, subjects) table; at most 8, with 20 raw subjects."""
    one_each = subjects.filter(F.size("subjects") > 0).groupBy(F.col("open_library_key").alias("_key")).agg(F.max("subjects").alias("subjects"))
    found = one_each.select("_key", F.slice("subjects", 1, 20).alias("_subjects"), subject_genres("subjects").alias("_genres"))
    df = ensure(df, "open_library_subjects")
    known = F.transform(items("genres"), lambda g: F.lower(g))
    added = F.filter(F.col("_genres"), lambda g: ~F.array_contains(known, F.lower(g)))
    hit = F.size(F.coalesce("_genres", F.array().cast("array<string>"))) > 0
    out = df.join(found, F.nullif(strip("open_library_key"), F.lit("")) == F.col("_key"), "left")
    return out.withColumns(
        {
            "genres": F.when(hit, F.slice(F.concat(items("genres"), added), 1, 8)).otherwise(F.col("genres")),
            "open_library_subjects": F.when(hit, F.col("_subjects")).otherwise(F.col("open_library_subjects")),
        }
    ).select(*df.columns)


def apply_enrichment(df: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """Put accepted results (row_key, polarity, emotions, themes, literary_mood) onto their rows."""
    df = ensure(df, "literary_mood", "enrichment_method", "enriched_by_model")
    table = results.select(
        F.col("row_key").alias("_key"),
        *[F.col(c).alias(f"_{c}") for c in ("polarity", "emotions", "themes", "literary_mood")],
    )
    out = df.join(table, F.col("row_key") == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    method = F.when(strip("passage") != "", F.lit("gemini_passage")).otherwise(F.lit("gemini_reputation"))
    return out.withColumns(
        {
            "polarity": F.when(hit, F.col("_polarity")).otherwise(F.col("polarity")),
            "emotions": F.when(hit, F.col("_emotions")).otherwise(F.col("emotions")),
            "themes": F.when(hit, F.col("_themes")).otherwise(F.col("themes")),
            "literary_mood": F.coalesce(F.nullif("_literary_mood", F.lit("")), "literary_mood"),
            "enrichment_method": F.when(hit, method).otherwise(F.col("enrichment_method")),
            "enriched_by_model": F.when(hit, F.lit(model)).otherwise(F.col("enriched_by_model")),
        }
    ).select(*df.columns)


def reset_filler(df: DataFrame) -> DataFrame:
    """Clear the sentiment of rows whose themes are filler, so that they are enriched again."""
    from tomeatlas.functions.themes import is_filler

    df = ensure(df, "literary_mood", "enrichment_method", "enriched_by_model")
    df = df.withColumn("_filler", is_filler())
    cleared = ("polarity", "emotions", "themes", "literary_mood", "enrichment_method", "enriched_by_model")
    return df.withColumns(
        {c: F.when(~F.col("_filler"), F.col(c)) for c in cleared}
    ).drop("_filler")


def narrative_rows(df: DataFrame, keys: Sequence[str], genre: str = "genre") -> DataFrame:
    """One row per key with its distinct genres joined by "|", in lexical order."""
    joined = F.array_join(F.array_sort(F.collect_set(genre)), "|")
    return df.groupBy(*keys).agg(joined.alias("genre_labels"))


# ---- composite places ----

def place_reference(df: DataFrame, vague: Sequence[str] = vocab.VAGUE_PLACES) -> DataFrame:
    """Mean coordinates of every atomic city-level place name."""
    usable = (strip("place_name") != "") & (place_granularity("place_name", vague) == "city")
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return (
        df.filter(usable & located)
        .groupBy(norm_text("place_name").alias("place_key"))
        .agg(F.avg("lon").alias("ref_lon"), F.avg("lat").alias("ref_lat"))
    )


def split_composites(df: DataFrame, vague: Sequence[str] = vocab.VAGUE_PLACES) -> DataFrame:
    """One row per atomic place of a composite label, located by the mean of the same place elsewhere.

    ``split_status`` is plain, resolved or unresolved; ``source_id`` keeps the id before the split.
    """
    df = ensure(
        df, "composite_source_place_name", "composite_split_part", "composite_split_total", "coordinate_source",
        "coordinate_confidence", "coordinate_precision_km", "geolocation_needs_review", "place_granularity",
    )
    reference = place_reference(df, vague)
    tagged = df.withColumn("_parts", F.when(is_composite(norm_text("place_name")), composite_parts("place_name")))
    splits = F.coalesce(F.size("_parts") > 1, F.lit(False))
    plain = tagged.filter(~splits).drop("_parts").withColumns(
        {"split_status": F.lit("plain"), "source_id": F.col("id")}
    )
    exploded = (
        tagged.filter(splits)
        .withColumn("composite_split_total", F.size("_parts"))
        .withColumn("composite_source_place_name", strip("place_name"))
        .select(*df.columns, F.posexplode("_parts").alias("_pos", "_part"))
        .withColumn("place_key", norm_text("_part"))
        .join(reference, "place_key", "left")
    )
    hit = F.col("ref_lon").isNotNull()
    part = F.col("_pos") + 1

    def pick(yes: Column, no: Column) -> Column:
        return F.when(hit, yes).otherwise(no)

    base_id = text("id")
    parts = exploded.withColumns(
        {
            "source_id": F.col("id"),
            "id": F.when(base_id != "", F.concat(base_id, F.lit("::p"), part.cast("string"))).otherwise(
                F.concat(F.lit("composite::"), part.cast("string"), F.lit("::"), F.col("place_key"))
            ),
            "place_name": F.col("_part"),
            "composite_split_part": part.cast("int"),
            "lon": pick(F.round("ref_lon", 6), F.col("lon")),
            "lat": pick(F.round("ref_lat", 6), F.col("lat")),
            "coordinate_source": pick(F.lit("composite_split_reference"), F.lit("composite_split_unresolved")),
            "coordinate_confidence": pick(F.lit(0.8), F.lit(0.3)),
            "coordinate_precision_km": pick(F.lit(20.0), F.lit(250.0)),
            "geolocation_needs_review": ~hit,
            "split_status": pick(F.lit("resolved"), F.lit("unresolved")),
        }
    )
    parts = with_geolocation_fields(parts, vague).select(*plain.columns)
    return plain.unionByName(parts)


def explode_composites(
    df: DataFrame, drop_unresolved: bool = True, vague: Sequence[str] = vocab.VAGUE_PLACES
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) after the split; strict mode removes unresolved parts.

    The removed side also has one row for every source row that lost a part, as the manifest
    counts both.
    """
    return separate_splits(split_composites(df, vague), drop_unresolved)


def separate_splits(split: DataFrame, drop_unresolved: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of rows tagged by ``split_composites``."""
    tags = ("split_status", "source_id")
    if not drop_unresolved:
        return split.drop(*tags), split.filter(F.lit(False)).drop(*tags)
    kept = split.filter(F.col("split_status") != "unresolved").drop(*tags)
    lost = split.filter(F.col("split_status") == "unresolved")
    sources = lost.dropDuplicates(["ord"]).withColumns(
        {"id": F.col("source_id"), "place_name": F.col("composite_source_place_name")}
    )
    return kept, lost.unionByName(sources).drop(*tags)
