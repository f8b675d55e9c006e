"""Derived quality columns: granularity, provenance, geospatial risk, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import ColumnLike, col, contains_any, is_one_of, items, let, strip, text
from tomeatlas.functions.text import is_composite, norm_text
from tomeatlas.schema import ensure

# Passage types that carry no text worth reading, penalties, tier scores.
STUB_PASSAGES = ("none", "short_stub", "wikidata_stub")
PENALTIES = {
    "composite_place_label": 0.45,
    "broad_or_region_place": 0.30,
    "uncertain_place_label": 0.35,
    "coarse_coordinate_precision": 0.15,
    "low_coordinate_confidence": 0.25,
    "low_spatial_precision": 0.20,
}
TIER_SCORES = {"gold": 1.0, "silver": 0.75, "stub": 0.35}


def place_granularity(place: ColumnLike = "place_name", vague: Sequence[str] = vocab.VAGUE_PLACES) -> Column:
    """"region" for empty, vague and composite labels, else "city"."""
    vague_words = r"(?U)\b(?:empire|continent|subcontinent|hemisphere)\b"

    def grain(p: Column) -> Column:
        region = (p == "") | is_one_of(p, vague) | p.rlike(vague_words) | is_composite(p)
        return F.when(region, F.lit("region")).otherwise(F.lit("city"))

    return let(norm_text(place), grain)


def with_geolocation_fields(df: DataFrame, vague: Sequence[str] = vocab.VAGUE_PLACES) -> DataFrame:
    """Granularity, and coordinate precision, confidence, source, review flag where absent."""
    df = ensure(
        df, "source", "coordinate_source", "coordinate_precision_km", "coordinate_confidence",
        "geolocation_needs_review",
    )
    source = F.lower(strip(F.coalesce(
        F.nullif("coordinate_source", F.lit("")), F.nullif("source", F.lit("")), F.lit("dataset")
    )))
    df = df.withColumn("place_granularity", place_granularity("place_name", vague))
    city = F.col("place_granularity") == "city"
    return df.withColumns(
        {
            "coordinate_precision_km": F.coalesce(
                "coordinate_precision_km", F.when(city, F.lit(15.0)).otherwise(F.lit(120.0))
            ),
            "coordinate_confidence": F.coalesce(
                "coordinate_confidence", F.when(city, F.lit(0.85)).otherwise(F.lit(0.45))
            ),
            "coordinate_source": F.when(source == "", F.lit("dataset")).otherwise(source),
            "geolocation_needs_review": F.coalesce("geolocation_needs_review", F.lit(False)),
        }
    )


def passage_source(source: ColumnLike = "source", url: ColumnLike = "open_library_url") -> Column:
    s = norm_text(source)
    return (
        F.when(F.contains(s, F.lit("openlibrary")), F.lit("openlibrary"))
        .when(s == "wikidata", F.lit("wikidata"))
        .when(F.contains(s, F.lit("wiki")), F.lit("wikipedia"))
        .when(text(url) != "", F.lit("openlibrary"))
        .when(s == "", F.lit("unknown"))
        .otherwise(s)
    )


def passage_type(passage: ColumnLike = "passage", source: ColumnLike = "passage_source") -> Column:
    """Kind of text, from its length, its source and whether it holds dialogue."""
    src = col(source)

    def kind(p: Column) -> Column:
        n = F.length(p)
        quotes = n - F.length(F.replace(p, F.lit('"'), F.lit("")))
        dialogue = (quotes >= 2) | F.contains(p, F.lit("'"))
        article = F.lower(F.left(p, F.lit(5))).rlike("^(?:this|a|an|the) ")
        return (
            F.when(n == 0, F.lit("none"))
            .when(n < 60, F.lit("short_stub"))
            .when((src == "wikidata") & (n < 320), F.lit("wikidata_stub"))
            .when(src == "openlibrary", F.lit("ol_description"))
            .when(src == "wikipedia", F.lit("wikipedia_summary"))
            .when((n >= 400) & dialogue & ~article, F.lit("literary_excerpt"))
            .otherwise(F.lit("other"))
        )

    return let(strip(passage), kind)


def enrichment_method(
    themes: ColumnLike = "themes", emotions: ColumnLike = "emotions", passage: ColumnLike = "passage"
) -> Column:
    enriched = (F.size(items(themes)) > 0) | (F.size(items(emotions)) > 0)
    return (
        F.when(~enriched, F.lit("none"))
        .when(strip(passage) != "", F.lit("gemini_passage"))
        .otherwise(F.lit("gemini_reputation"))
    )


def _few_decimals(c: Column) -> Column:
    """At most one digit after the point in the shortest decimal form of the number."""
    x = F.abs(c)
    s = x.cast("string")
    return (
        F.when((x >= 1e-3) | (x == 0), F.length(F.substring_index(s, ".", -1)) <= 1)
        .when(x >= 1e-4, F.lit(False))
        .otherwise(s.rlike(r"^\d\.0E"))
    )


def geo_quality() -> Column:
    """``struct(flags, score)``: the risks of a row, and 1 less the penalty of each, at least 0."""

    def rate(x: Column) -> Column:
        coarse = F.coalesce(_few_decimals(F.col("lon")) | _few_decimals(F.col("lat")), F.lit(True))
        risks = {
            "composite_place_label": is_composite("place_name"),
            "broad_or_region_place": (x["grain"] == "region") | contains_any(x["place"], vocab.BROAD_PLACE_HINTS),
            "uncertain_place_label": contains_any(x["place"], vocab.UNCERTAIN_LABEL_HINTS),
            "coarse_coordinate_precision": coarse,
            "low_coordinate_confidence": F.coalesce("coordinate_confidence", F.lit(0.0)) <= 0.35,
            "low_spatial_precision": F.coalesce("coordinate_precision_km", F.lit(0.0)) >= 100,
        }
        return F.array_compact(
            F.array(
                *[F.when(c, F.struct(F.lit(n).alias("flag"), F.lit(PENALTIES[n]).alias("penalty"))) for n, c in risks.items()]
            )
        )

    def score(found: Column) -> Column:
        rest = F.aggregate(found, F.lit(1.0), lambda left, r: left - r["penalty"])
        return F.struct(
            F.transform(found, lambda r: r["flag"]).alias("flags"), F.greatest(F.lit(0.0), rest).alias("score")
        )

    grain = F.lower(strip(F.coalesce("place_granularity", F.lit("city"))))
    return let(let(F.struct(grain.alias("grain"), F.lower(strip("place_name")).alias("place")), rate), score)


def with_geo_quality(df: DataFrame) -> DataFrame:
    """Risk flags and ``geo_quality`` of every row."""
    df = ensure(df, "place_granularity", "coordinate_confidence", "coordinate_precision_km")
    rated = df.withColumn("_geo", geo_quality())
    return rated.withColumns({"geo_risk_flags": F.col("_geo.flags"), "geo_quality": F.col("_geo.score")}).drop("_geo")


def has_core_metadata() -> Column:
    year = F.coalesce(F.col("publish_year"), F.lit(0))
    return (strip("book_title") != "") & (strip("author") != "") & (year > 0)


def is_specific_place() -> Column:
    return F.lower(strip(F.coalesce("place_granularity", F.lit("city")))) != "region"


def tier_strict() -> Column:
    """gold: long passage, 3 themes, 2 emotions, polarity; silver: metadata and a specific place."""
    readable = (F.length(strip("passage")) >= 150) & ~F.lower(strip("passage_type")).isin(*STUB_PASSAGES)
    enriched = (F.size(items("themes")) >= 3) & (F.size(items("emotions")) >= 2)
    polarity = F.coalesce(F.col("polarity"), F.lit(0.0)) != 0
    return (
        F.when(readable & enriched & polarity, F.lit("gold"))
        .when(has_core_metadata() & is_specific_place(), F.lit("silver"))
        .otherwise(F.lit("stub"))
    )


def tier_lenient() -> Column:
    """The tier already on the row, else one from presence of passage and themes."""
    given = F.lower(strip("quality_tier"))
    has_passage, has_themes = strip("passage") != "", F.size(items("themes")) > 0
    return (
        F.when(given.isin(*TIER_SCORES), given)
        .when(has_passage & has_themes & is_specific_place(), F.lit("gold"))
        .when(has_passage | has_themes, F.lit("silver"))
        .otherwise(F.lit("stub"))
    )


def tier_or_strict() -> Column:
    """The tier already on the row, else the strict one."""
    return F.coalesce(F.nullif("quality_tier", F.lit("")), tier_strict())


def quality_gate(
    df: DataFrame,
    threshold: float = 0.55,
    geo_threshold: float = 0.60,
    allow_composite: bool = False,
    reject: bool = False,
) -> DataFrame:
    """Tier, geospatial quality, overall score and verdict per row; optionally only passing rows."""
    df = ensure(df, "passage_type", "place_granularity", "coordinate_confidence", "coordinate_precision_km")
    tier_score = F.create_map(*[F.lit(x) for kv in TIER_SCORES.items() for x in kv])

    def overall(x: Column) -> Column:
        score = F.element_at(tier_score, x["tier"]) * 0.7 + x["geo"]["score"] * 0.3
        return F.struct(x["tier"].alias("tier"), x["geo"].alias("geo"), F.round(score, 3).alias("score"))

    def verdict(x: Column) -> Column:
        passed = (x["score"] >= threshold) & (x["geo"]["score"] >= geo_threshold)
        if not allow_composite:
            passed = passed & ~F.array_contains(x["geo"]["flags"], "composite_place_label")
        return F.struct(x["tier"].alias("tier"), x["geo"].alias("geo"), x["score"].alias("score"), passed.alias("passed"))

    # one expression per row: a filter on the verdict then repeats it once, not once per column used
    inputs = F.struct(tier_strict().alias("tier"), geo_quality().alias("geo"))
    gated = df.withColumn("_gate", let(let(inputs, overall), verdict)).withColumns(
        {
            "quality_tier": F.col("_gate.tier"),
            "geo_quality": F.col("_gate.geo.score"),
            "geo_risk_flags": F.col("_gate.geo.flags"),
            "quality_score": F.col("_gate.score"),
            "quality_passed": F.col("_gate.passed"),
        }
    )
    gated = gated.drop("_gate")
    return gated.filter("quality_passed") if reject else gated


def sentiment_bucket(polarity: ColumnLike = "polarity", inclusive: bool = True) -> Column:
    """Sign of the sentiment outside a neutral band of 0.2, its edges inside or outside."""
    p = F.coalesce(col(polarity), F.lit(0.0))
    positive = p >= 0.2 if inclusive else p > 0.2
    negative = p <= -0.2 if inclusive else p < -0.2
    return F.when(positive, F.lit("positive")).when(negative, F.lit("negative")).otherwise(F.lit("neutral"))
