"""Enrichment: choose rows, run a batch function, put accepted results back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import strip
from tomeatlas.functions.themes import (
    clamp_polarity,
    needs_enrichment,
    sanitize_emotions,
    sanitize_themes,
    with_generic_flag,
    with_overrides,
)
from tomeatlas.operators.dedup import pending, select_keys, with_row_key
from tomeatlas.operators.extract import infer
from tomeatlas.operators.joins import apply_enrichment
from tomeatlas.operators.select import enrichment_score, select_diverse, unenriched

RESULT_TYPE = "struct<polarity:double,dominant_emotions:array<string>,themes:array<string>,literary_mood:string>"


def batch_rows(places: DataFrame) -> DataFrame:
    """What the batch function sees of a row."""
    return places.select(
        "row_key", "id", "ord", "book_title", "author", "publish_year", "place_name", "region", "language",
        F.array_join("genres", ", ").alias("genres_csv"), F.col("genres"), F.col("passage"),
    )


def to_enrich(
    places: DataFrame, keys: DataFrame | None = None, processed: DataFrame | None = None, passage_only: bool = False
) -> DataFrame:
    """Rows that need enrichment, are selected, and were not processed before.

    Cheap filters and key joins come first, so the batch function only sees what is left.
    """
    rows = with_row_key(places).filter(needs_enrichment())
    if passage_only:
        rows = rows.filter(strip("passage") != "")
    if keys is not None:
        rows = select_keys(rows, keys, "row_key")
    if processed is not None:
        rows = pending(rows, processed, "row_key")
    return rows


def reviewed_results(results: DataFrame) -> DataFrame:
    """Accepted outputs cleaned, checked for generic themes and adjusted to title, genre and place."""
    parsed = results.filter(F.col("status") == "ok").withColumn("_r", F.from_json("result", RESULT_TYPE))
    cleaned = parsed.withColumns(
        {
            "polarity": clamp_polarity("_r.polarity"),
            "emotions": sanitize_emotions("_r.dominant_emotions"),
            "themes": sanitize_themes("_r.themes"),
            "literary_mood": F.col("_r.literary_mood"),
        }
    )
    flagged = with_generic_flag(cleaned).filter(~F.col("looks_generic"))
    return with_overrides(flagged).select("row_key", "polarity", "emotions", "themes", "literary_mood")


def run_enrichment(
    places: DataFrame,
    editions: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    limit: int,
    model: str,
    mode: str = "relaxed",
) -> dict[str, DataFrame]:
    """Selection, inference, review and application in one go."""
    candidates = unenriched(places)
    selection = select_diverse(enrichment_score(candidates, editions), limit)
    rows = to_enrich(places, selection.select("row_key"))
    results = infer(batch_rows(rows), fn, mode)
    data = apply_enrichment(with_row_key(places), reviewed_results(results), model)
    return {"data": data, "selection": selection, "results": results}
