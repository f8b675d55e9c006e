"""The book-place record as one flat row, and the row-level mappings to other shapes.

``ord`` is the position of a row in its dataset; "first wins" rules, ties and pages use it, so
it is assigned once at ingest and stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _DBL, _INT, _BOOL = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_LIST = T.ArrayType(_STR)

# snake_case column -> (camelCase field, type); coordinates and sentiment are packed separately
FIELDS: dict[str, tuple[str, T.DataType]] = {
    "id": ("id", _STR),
    "book_title": ("bookTitle", _STR),
    "author": ("author", _STR),
    "publish_year": ("publishYear", _INT),
    "place_name": ("placeName", _STR),
    "place_type": ("placeType", _STR),
    "real_anchor": ("realAnchor", _STR),
    "setting_type": ("settingType", _STR),
    "narrative_era": ("narrativeEra", _STR),
    "passage": ("passage", _STR),
    "language": ("language", _STR),
    "genres": ("genres", _LIST),
    "region": ("region", _STR),
    "country": ("country", _STR),
    "source": ("source", _STR),
    "cover_url": ("coverUrl", _STR),
    "open_library_key": ("openLibraryKey", _STR),
    "open_library_url": ("openLibraryUrl", _STR),
    "open_library_subjects": ("openLibrarySubjects", _LIST),
    "goodreads_url": ("goodreadsUrl", _STR),
    "translator": ("translator", _STR),
    "wikidata_book_id": ("wikidataBookId", _STR),
    "wikidata_place_id": ("wikidataPlaceId", _STR),
    "wikidata_book_qid": ("wikidataBookQid", _STR),
    "wikidata_place_qid": ("wikidataPlaceQid", _STR),
    "qa_flags": ("qaFlags", _LIST),
    "nearest_known_city": ("nearestKnownCity", _STR),
    "nearest_known_city_distance_km": ("nearestKnownCityDistanceKm", _DBL),
    "region_inferred": ("regionInferred", _BOOL),
    "place_granularity": ("placeGranularity", _STR),
    "coordinate_precision_km": ("coordinatePrecisionKm", _DBL),
    "coordinate_confidence": ("coordinateConfidence", _DBL),
    "coordinate_source": ("coordinateSource", _STR),
    "geolocation_needs_review": ("geolocationNeedsReview", _BOOL),
    "composite_source_place_name": ("compositeSourcePlaceName", _STR),
    "composite_split_part": ("compositeSplitPart", _INT),
    "composite_split_total": ("compositeSplitTotal", _INT),
    "passage_source": ("passageSource", _STR),
    "passage_type": ("passageType", _STR),
    "enrichment_method": ("enrichmentMethod", _STR),
    "literary_mood": ("literaryMood", _STR),
    "enriched_by_model": ("enrichedByModel", _STR),
    "quality_tier": ("qualityTier", _STR),
    "geo_quality": ("geoQuality", _DBL),
    "geo_risk_flags": ("geoRiskFlags", _LIST),
    "quality_score": ("qualityScore", _DBL),
    "quality_passed": ("qualityPassed", _BOOL),
}

_FLAT: dict[str, T.DataType] = {
    "ord": T.LongType(),
    **{name: dtype for name, (_, dtype) in FIELDS.items()},
    "lon": _DBL,
    "lat": _DBL,
    "polarity": _DBL,
    "emotions": _LIST,
    "themes": _LIST,
}

PLACE = T.StructType([T.StructField(name, dtype) for name, dtype in _FLAT.items()])

SENTIMENT = T.StructType(
    [
        T.StructField("polarity", _DBL),
        T.StructField("dominantEmotions", _LIST),
        T.StructField("themes", _LIST),
    ]
)

# one record of the JSON envelope
CAMEL = T.StructType(
    [T.StructField(camel, dtype) for camel, dtype in FIELDS.values()]
    + [T.StructField("coordinates", T.ArrayType(_DBL)), T.StructField("sentiment", SENTIMENT)]
)


def ensure(df: DataFrame, *names: str) -> DataFrame:
    """Add the named record columns that ``df`` lacks, as nulls of the record's type."""
    missing = {n: F.lit(None).cast(_FLAT[n]) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame) -> DataFrame:
    """All record columns, in order and with the record's types."""
    df = ensure(df, *_FLAT)
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in _FLAT.items()])


def to_snake(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat row from camelCase fields; fields the record allows to be missing get its defaults."""
    defaults = {
        "id": "", "book_title": "", "author": "", "place_name": "", "narrative_era": "", "passage": "",
        "region": "", "place_type": "real", "setting_type": "primary", "language": "English",
        "source": "manual",
    }
    out = []
    for name, (camel, dtype) in FIELDS.items():
        value = F.col(camel) if camel in df.columns else F.lit(None)
        value = value.cast(dtype)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        if name == "genres":
            value = F.coalesce(value, F.array().cast(_LIST))
        out.append(value.alias(name))
    pair = F.when(F.size("coordinates") == 2, F.col("coordinates"))
    empty = F.array().cast(_LIST)
    return df.select(
        *keep,
        *out,
        F.get(pair, F.lit(0)).alias("lon"),
        F.get(pair, F.lit(1)).alias("lat"),
        F.coalesce(F.col("sentiment.polarity"), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.col("sentiment.dominantEmotions"), empty).alias("emotions"),
        F.coalesce(F.col("sentiment.themes"), empty).alias("themes"),
    )


def to_camel(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """camelCase fields with packed coordinates and sentiment, for JSON sinks and readers of them."""
    from tomeatlas.functions.quality import tier_lenient

    df = ensure(df, *_FLAT)
    unknown = {
        "place_type": "real", "setting_type": "primary", "language": "English", "id": "", "book_title": "",
        "author": "", "place_name": "", "narrative_era": "", "passage": "", "region": "", "source": "",
        "passage_source": "unknown", "passage_type": "none", "enrichment_method": "none",
    }
    empty = F.array().cast(_LIST)
    values = {}
    for name, (camel, dtype) in FIELDS.items():
        value = F.col(name).cast(dtype)
        if name in unknown:
            value = F.coalesce(value, F.lit(unknown[name]))
        elif name == "genres":
            value = F.coalesce(value, empty)
        elif name == "place_granularity":
            value = F.when(F.lower(value) == "region", F.lit("region")).otherwise(F.lit("city"))
        elif name == "quality_tier":
            value = tier_lenient()
        values[camel] = value
    has_point = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    values["coordinates"] = F.when(has_point, F.array("lon", "lat")).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    values["sentiment"] = F.struct(
        F.coalesce("polarity", F.lit(0.0)).alias("polarity"),
        F.coalesce("emotions", empty).alias("dominantEmotions"),
        F.coalesce("themes", empty).alias("themes"),
    )
    return df.select(*keep, *[v.alias(k) for k, v in values.items()])
