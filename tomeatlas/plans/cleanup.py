"""Clean-up of a place dataset and its manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.quality import (
    enrichment_method,
    passage_source,
    passage_type,
    place_granularity,
    with_geolocation_fields,
)
from tomeatlas.functions.text import clean_language
from tomeatlas.functions.titles import is_ambiguous_title, is_nonfiction_title, is_title_city_mismatch
from tomeatlas.operators.dedup import dedup_best
from tomeatlas.operators.joins import separate_splits, split_composites
from tomeatlas.plans.scratch import materialise
from tomeatlas.schema import ensure

_MANIFEST = ("id", "book_title", "author", "place_name")


def removal_reason():
    """First reason against a row, null when it stays."""
    return (
        F.when(is_nonfiction_title(), F.lit("nonfiction_title"))
        .when(is_ambiguous_title(), F.lit("ambiguous_title"))
        .when(is_title_city_mismatch(), F.lit("title_city_mismatch"))
    )


def with_provenance(df: DataFrame, vague: Sequence[str] = vocab.VAGUE_PLACES) -> DataFrame:
    """Language label, geolocation fields, passage source and type, enrichment method."""
    df = ensure(df, "source", "open_library_url", "language")
    df = with_geolocation_fields(df.withColumn("language", clean_language("language")), vague)
    df = df.withColumn("passage_source", passage_source())
    return df.withColumns({"passage_type": passage_type(), "enrichment_method": enrichment_method()})


def run_cleanup(
    places: DataFrame, drop_unresolved: bool = True, vague: Sequence[str] = vocab.VAGUE_PLACES
) -> dict[str, DataFrame]:
    """Cleaned rows (``data``), removed rows with reasons (``removed``) and stage counts (``report``).

    Tagged and split rows are written to the shared folder once; what is kept, removed and counted
    is read from there.
    """
    tagged = places.withColumns(
        {"place_granularity": place_granularity("place_name", vague), "reason": removal_reason()}
    )
    dropped = tagged.filter(F.col("reason").isNotNull())
    split = split_composites(tagged.filter(F.col("reason").isNull()), vague)
    stage = materialise(split.unionByName(dropped, allowMissingColumns=True), "cleanup")
    dropped = stage.filter(F.col("reason").isNotNull())
    atomic, unresolved = separate_splits(stage.filter(F.col("reason").isNull()).drop("reason"), drop_unresolved)
    best, displaced = dedup_best(atomic, ["ord", "composite_split_part"])
    removed = cleanup_manifest(
        dropped,
        unresolved.withColumn("reason", F.lit("composite_place_unresolved")),
        displaced.withColumn("reason", F.lit("duplicate_title_author_place")),
    )
    data = with_provenance(best, vague)
    return {"data": data, "removed": removed, "report": removal_counts(removed)}


def cleanup_manifest(*removals: DataFrame) -> DataFrame:
    """Removed rows of all stages with their reasons."""
    out = None
    for df in removals:
        part = df.select(*_MANIFEST, "reason")
        out = part if out is None else out.unionByName(part)
    return out


def removal_counts(removed: DataFrame) -> DataFrame:
    return removed.groupBy("reason").agg(F.count("*").alias("entries"))


def run_nonfiction_filter(places: DataFrame) -> dict[str, DataFrame]:
    """Split off rows that are not fiction, with the reason."""
    from tomeatlas.functions.titles import nonfiction_reason

    tagged = places.withColumn("reason", nonfiction_reason())
    return {
        "data": tagged.filter(F.col("reason").isNull()).drop("reason"),
        "removed": tagged.filter(F.col("reason").isNotNull()),
    }
