"""Tables that a front end reads instead of computing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.operators.profiles import (
    books_from_entries,
    city_profile,
    city_radar,
    city_stats,
    comparable_cities,
    corpus_stats,
    facets,
)
from tomeatlas.operators.search import reading_list_counts
from tomeatlas.operators.vectors import similar_works
from tomeatlas.sources.writers import common_themes, detail_documents, hero_subset, slim_index


def serving_tables(
    places: DataFrame, vectors: DataFrame | None = None, hero: int = 500, shown: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All serving tables by name; ``vectors`` (ord, embedding) of books adds works similar to the ``shown`` ones (ord),
    by default to those of the hero table."""
    tables = {
        "index": slim_index(places),
        "details": detail_documents(places),
        "hero": hero_subset(places, hero),
        "themes": common_themes(places),
        "facets": facets(places),
        "corpus": corpus_stats(places),
        "city_profiles": city_profile(places),
        "city_radar": city_radar(places),
        "city_stats": city_stats(places),
        "cities": comparable_cities(places),
        "reading_lists": reading_list_counts(places),
    }
    if vectors is not None:
        books = books_from_entries(places).join(vectors, "ord")
        tables["similar"] = similar_works(tables["hero"] if shown is None else shown, books)
    return tables


def write_serving_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def serving_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per serving table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("entries")).select(F.lit(name).alias("table"), "entries")
        out = part if out is None else out.unionByName(part)
    return out
