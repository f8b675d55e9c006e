"""Search, facets, reading lists, paging over the place dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import col, items, strings, strip, text
from tomeatlas.functions.text import era_bucket
from tomeatlas.functions.trigram import similarity
from tomeatlas.schema import ensure


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search_all_terms(df: DataFrame, query: str) -> DataFrame:
    """Rows in which every term occurs somewhere in title, author, place, genres, themes, passage."""
    haystack = F.lower(
        F.concat_ws(
            " ", text("book_title"), text("author"), text("place_name"),
            F.array_join(items("genres"), " "), F.array_join(items("themes"), " "), text("passage"),
        )
    )
    return df.filter(_all([F.contains(haystack, F.lit(t)) for t in query.lower().split()]))


def search_contains(df: DataFrame, query: str) -> DataFrame:
    """Rows in which one of title, author, place, passage, themes, emotions contains the phrase."""
    if not query.strip():
        return df
    q = F.lit(query.lower())

    def in_list(c: str) -> Column:
        return F.exists(items(c), lambda t: F.contains(F.replace(t, F.lit("_"), F.lit(" ")), q))

    plain = [F.contains(F.lower(text(c)), q) for c in ("book_title", "author", "place_name", "passage")]
    return df.filter(reduce(lambda a, b: a | b, [*plain, in_list("themes"), in_list("emotions")]))


def filter_places(
    df: DataFrame,
    region: str | None = None,
    author: str | None = None,
    city: str | None = None,
    genre: str | None = None,
) -> DataFrame:
    """Region as a whole, author, city and any genre by substring, all case-blind."""
    conditions = []
    if region:
        conditions.append(F.lower(text("region")) == region.lower())
    if author:
        conditions.append(F.contains(F.lower(text("author")), F.lit(author.lower())))
    if city:
        conditions.append(F.contains(F.lower(text("place_name")), F.lit(city.lower())))
    if genre:
        conditions.append(F.exists(items("genres"), lambda g: F.contains(F.lower(g), F.lit(genre.lower()))))
    return df.filter(_all(conditions))


def filter_years(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Years within bounds; a bound of 0 is no bound and an unknown year fails both."""
    year = F.nullif("publish_year", F.lit(0))
    conditions = []
    if low:
        conditions.append(F.coalesce(year, F.lit(0)) >= low)
    if high:
        conditions.append(F.coalesce(year, F.lit(9999)) <= high)
    return df.filter(_all(conditions))


def filter_facets(
    df: DataFrame,
    regions: Sequence[str] = (),
    genres: Sequence[str] = (),
    languages: Sequence[str] = (),
    eras: Sequence[str] = (),
) -> DataFrame:
    """Multi-select facets: any of the values within one facet, all facets together."""
    conditions = []
    if regions:
        conditions.append(col("region").isin(*regions))
    if genres:
        conditions.append(F.arrays_overlap(items("genres"), strings(genres)))
    if languages:
        language = F.coalesce(F.nullif("language", F.lit("")), F.lit("Unknown"))
        conditions.append(language.isin(*languages))
    if eras:
        conditions.append(era_bucket("publish_year").isin(*eras))
    return df.filter(_all(conditions))


def reading_lists(metros: Sequence[str] = vocab.METROS) -> dict[str, Column]:
    """Predicate of each curated list."""
    title = F.lower(text("book_title"))
    # Titles and labels that define the lists.
    partition_titles = ["partition", "train to pakistan", "tamas", "ice-candy-man"]
    noir_genres = ["crime", "mystery", "thriller"]

    def theme_has(part: str) -> Column:
        return F.exists(items("themes"), lambda t: F.contains(t, F.lit(part)))

    noir = F.arrays_overlap(items("genres"), strings(noir_genres)) | theme_has("corruption")
    return {
        "partition-fiction": theme_has("partition")
        | reduce(lambda a, b: a | b, [F.contains(title, F.lit(p)) for p in partition_titles]),
        "mumbai-noir": (text("place_name") == "Mumbai") & noir,
        "translation": ~text("language").isin("English", "Unknown", ""),
        "historical-fiction": F.array_contains(items("genres"), "historical fiction"),
        "small-towns": (text("region") == "South Asia") & ~text("place_name").isin(*metros),
    }


def reading_list(df: DataFrame, name: str) -> DataFrame:
    return df.filter(reading_lists()[name])


def reading_list_counts(df: DataFrame) -> DataFrame:
    """Entries per list, counted in one pass."""
    lists = reading_lists()
    counts = df.agg(*[F.count_if(p).alias(n) for n, p in lists.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("entries")) for n in lists])
    return counts.select(F.inline(pairs))


def map_visible(df: DataFrame) -> DataFrame:
    """City-level rows above stub, or all city-level rows where there is none above stub."""
    df = ensure(df, "place_granularity", "quality_tier")
    cities = df.filter(F.coalesce("place_granularity", F.lit("city")) != "region")
    above = F.coalesce("quality_tier", F.lit("stub")) != "stub"
    some_above = cities.agg(F.coalesce(F.bool_or(above), F.lit(False))).scalar()
    return cities.filter(above | ~some_above)


def get_place(df: DataFrame, place_id: str) -> DataFrame:
    return df.filter(F.col("id") == place_id).orderBy("ord").limit(1)


def under_path(path: Column | str, prefix: str) -> Column:
    """The path is the prefix or lies below it."""
    return (col(path) == prefix) | F.startswith(col(path), F.lit(prefix + "."))


def path_matches(path: Column | str, *levels: str | Sequence[str] | None) -> Column:
    """Path pattern by level: a label, alternatives, or None for any number of levels at the end."""
    pattern = "^"
    for i, level in enumerate(levels):
        if level is None:
            pattern += r"(?:\.[^.]+)*"
            continue
        names = [level] if isinstance(level, str) else list(level)
        pattern += (r"\." if i else "") + "(?:" + "|".join(names) + ")"
    return col(path).rlike(pattern + "$")


def ledger_search(df: DataFrame, query: str, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Rows whose joined fields and list entries contain the phrase."""
    parts = [text(f) for f in fields] + [F.array_join(items(c), " ") for c in lists]
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(query.strip().lower())))


def backfill_candidates(
    df: DataFrame, kind: str, source: str | None = None, min_genres: int = 0, limit: int = 0
) -> DataFrame:
    """Rows worth a look-up: ``description`` and ``summary`` lack a passage, ``genres`` has a key."""
    df = ensure(df, "source", "wikidata_book_qid", "open_library_key")
    no_passage = strip("passage") == ""
    if kind == "description":
        keep = no_passage & (F.lit(True) if source in (None, "all") else text("source") == source)
    elif kind == "summary":
        keep = no_passage & (text("wikidata_book_qid") != "")
    elif kind == "genres":
        keep = strip("open_library_key") != ""
        if min_genres > 0:
            keep = keep & (F.size(items("genres")) < min_genres)
    else:
        raise ValueError(f"unknown kind of backfill: {kind}")
    out = df.filter(keep)
    return out.orderBy("ord").limit(limit) if limit > 0 else out


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.orderBy("ord").offset(offset).limit(limit)


def order_results(df: DataFrame) -> DataFrame:
    """Gold, silver, stub, others; newest first; then list order."""
    df = ensure(df, "quality_tier")
    tier = F.coalesce("quality_tier", F.lit("stub"))
    rank = F.when(tier == "gold", 0).when(tier == "silver", 1).when(tier == "stub", 2).otherwise(3)
    return df.orderBy(rank, F.coalesce("publish_year", F.lit(0)).desc(), "ord")


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """Most frequent values of a (value, entries) table, ties by value."""
    return counts.orderBy(F.col("entries").desc(), F.col("value")).limit(n)


def fuzzy_search(df: DataFrame, query: str, k: int = 50, threshold: float = 0.3) -> DataFrame:
    """Best trigram similarity of title, author, place with the query, or the phrase in the passage."""
    names = ("book_title", "author", "place_name")
    scored = df.withColumns({f"_s{i}": similarity(c, query) for i, c in enumerate(names)})
    rank = F.greatest("_s0", "_s1", "_s2")
    in_passage = F.contains(F.lower(text("passage")), F.lit(query.lower()))
    return (
        scored.withColumn("match_rank", rank)
        .filter((F.col("match_rank") >= threshold) | in_passage)
        .drop("_s0", "_s1", "_s2")
        .orderBy(F.col("match_rank").desc(), "ord")
        .limit(k)
    )
