"""City, author, book and corpus profiles.

Arrays in results hold a bounded number of entries (top ten and the like) or distinct labels; long
groups are ranked with map-side pruning and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeatlas.functions.expr import col, items, strings, text
from tomeatlas.functions.quality import tier_lenient
from tomeatlas.functions.text import decade, theme_label
from tomeatlas.operators.dedup import dedup_first, top_k_per_group
from tomeatlas.plans.scratch import materialise
from tomeatlas.schema import ensure


def value_counts(df: DataFrame, column: Column | str, name: str = "value") -> DataFrame:
    counts = df.groupBy(col(column).alias(name)).agg(F.count("*").alias("entries"))
    return counts.orderBy(F.col("entries").desc(), name)


# ---- city theme profiles ----


def city_profile(df: DataFrame, city: str | None = None, min_books: int = 3, themes: int = 10, authors: int = 10) -> DataFrame:
    """Theme weights, authors and languages of every city with enough books.

    A weight is the theme's count over the count of the city's strongest theme.
    """
    df = df.withColumn("city", F.lower(text("place_name")))
    if city is not None:
        df = df.filter(F.col("city") == city.lower())
    none = F.nullif(text("language"), F.lit(""))
    books = (
        df.groupBy("city")
        .agg(F.count("*").alias("book_count"), F.array_sort(F.collect_set(none)).alias("languages"))
        .filter(F.col("book_count") >= min_books)
    )

    def entry(kind: str, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"))

    # themes, authors and languages are counted and ranked together; authors go by name
    labels = F.concat(
        F.array(entry("author", text("author")), entry("language", text("language"))),
        F.transform(items("themes"), lambda t: entry("theme", t)),
    )
    counts = df.select("city", F.inline(labels)).groupBy("city", "kind", "label").agg(F.count("*").alias("n"))
    weight = F.when(F.col("kind") == "author", F.lit(0)).otherwise(-F.col("n"))
    ranked = top_k_per_group(counts, ["city", "kind"], [weight, F.col("label")], max(themes, authors))

    def listed(kind: str, most: int, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= most), value)))

    top = ranked.groupBy("city").agg(
        listed("theme", themes, F.struct("rank", F.col("label").alias("name"), F.col("n").alias("book_count"))).alias("t"),
        listed("author", authors, F.col("label")).alias("top_authors"),
        F.max(F.when(F.col("kind") == "theme", F.col("n"))).alias("top"),
        F.max(F.when((F.col("kind") == "language") & (F.col("rank") == 1), F.col("label"))).alias("dominant_language"),
    )
    weighted = F.transform(
        "t",
        lambda t: F.struct(
            t["name"].alias("name"), F.round(t["book_count"] / F.col("top"), 3).alias("weight"), t["book_count"].alias("book_count")
        ),
    )
    return (
        books.join(top.filter(F.size("t") > 0), "city")
        .select("city", "book_count", weighted.alias("themes"), "top_authors", "dominant_language", "languages")
    )


def city_radar(df: DataFrame, axes: int = 8, min_books: int = 3, min_themes: int = 3) -> DataFrame:
    """Radar axes (city, label, value, theme_count) from gold rows, else silver, else all rows.

    A tier is used when it has ``min_books`` rows with themes in the city.
    """
    df = ensure(df, "quality_tier")
    size = F.size(items("themes"))
    per_city = df.groupBy("place_name").agg(
        F.count("*").alias("books"),
        F.count_if((F.col("quality_tier") == "gold") & (size > 0)).alias("gold"),
        F.count_if((F.col("quality_tier") == "silver") & (size > 0)).alias("silver"),
    )
    # count per tier first, choose the tier's scope afterwards on the small result
    counts = (
        df.select("place_name", F.coalesce("quality_tier", F.lit("")).alias("tier"), F.explode(items("themes")).alias("theme"))
        .groupBy("place_name", "theme")
        .agg(
            F.count_if(F.col("tier") == "gold").alias("n_gold"),
            F.count_if(F.col("tier") == "silver").alias("n_silver"),
            F.count("*").alias("n_all"),
        )
    )
    n = (
        F.when(F.col("gold") >= min_books, F.col("n_gold"))
        .when(F.col("silver") >= min_books, F.col("n_silver"))
        .otherwise(F.col("n_all"))
    )
    scoped = (
        counts.join(per_city.filter(F.col("books") >= min_books), "place_name")
        .withColumn("theme_count", n)
        .filter(F.col("theme_count") > 0)
    )
    totals = scoped.groupBy("place_name").agg(
        F.count("*").alias("total_themes"), F.max("theme_count").alias("top")
    ).filter(F.col("total_themes") >= min_themes)
    ranked = top_k_per_group(
        scoped.select("place_name", "books", "theme", "theme_count"),
        ["place_name"], [F.col("theme_count").desc(), F.col("theme")], axes,
    )
    return ranked.join(totals, "place_name").select(
        F.col("place_name").alias("city"), "rank", theme_label("theme").alias("label"),
        (F.col("theme_count") / F.col("top")).alias("value"), "theme_count",
        F.col("books").alias("total_books"), "total_themes",
    )


def comparable_cities(df: DataFrame, current: str | None = None, min_books: int = 3) -> DataFrame:
    counts = df.groupBy(F.col("place_name").alias("city")).agg(F.count("*").alias("entries"))
    counts = counts.filter(F.col("entries") >= min_books)
    if current is not None:
        counts = counts.filter(F.col("city") != current)
    return counts.orderBy(F.col("entries").desc(), "city")


def compare_cities(radar: DataFrame, a: str, b: str, labels: int = 10) -> DataFrame:
    """Axes of two cities side by side, those of the first one first, absent ones at 0."""

    def side(city: str, value: str, place: str) -> DataFrame:
        chosen = radar.filter(F.col("city") == city)
        return chosen.select("label", F.col("value").alias(value), F.col("rank").alias(place))

    both = side(a, "value_a", "ra").join(side(b, "value_b", "rb"), "label", "full")
    return (
        both.orderBy(F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last())
        .limit(labels)
        .select("label", F.coalesce("value_a", F.lit(0.0)).alias("value_a"), F.coalesce("value_b", F.lit(0.0)).alias("value_b"))
    )


def city_stats(df: DataFrame) -> DataFrame:
    """Entries, distinct authors and languages, and the three most frequent decades per city."""
    year = F.nullif("publish_year", F.lit(0))
    base = df.groupBy("place_name").agg(
        F.count("*").alias("entries"),
        F.count_distinct(text("author")).alias("authors"),
        F.count_distinct(F.nullif("language", F.lit(""))).alias("languages"),
    )
    decades = (
        df.filter(year.isNotNull())
        .groupBy("place_name", decade("publish_year").alias("decade"))
        .agg(F.count("*").alias("n"))
    )
    top = (
        top_k_per_group(decades, ["place_name"], [F.col("n").desc(), F.col("decade")], 3)
        .groupBy("place_name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "decade"))).alias("d"))
    )
    none = F.array().cast("array<string>")
    return base.join(top, "place_name", "left").select(
        "place_name", "entries", "authors", "languages",
        F.coalesce(F.col("d.decade"), none).alias("top_decades"),
    )


def corpus_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct works, authors, cities; sketches instead of exact counts on request."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias("places"),
        count("book_title").alias("works"),
        count("author").alias("authors"),
        count("place_name").alias("cities"),
    )


def facets(df: DataFrame) -> DataFrame:
    """Long table (facet, value, entries) of regions, genres and languages, from one pass."""
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit("Unknown"))

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    genre_entries = F.transform(items("genres"), lambda g: entry("genre", g))
    entries = F.concat(F.array(entry("region", text("region")), entry("language", language)), genre_entries)
    return df.select(F.inline(entries)).groupBy("facet", "value").agg(F.count("*").alias("entries"))


# ---- books ----


def books_from_entries(df: DataFrame) -> DataFrame:
    """One row per (title, author): distinct cities, themes, emotions; id and genres of the first row."""
    first = F.min_by(F.struct("id", "genres", "ord"), "ord").alias("first")
    has_passage = text("passage") != ""
    # fixed-size partial state for hot books: repeated labels collapse before the shuffle
    base = df.groupBy("book_title", "author").agg(
        first,
        F.count("*").alias("entries"),
        F.count_if(has_passage).alias("passages"),
        F.min_by(F.when(has_passage, F.col("passage")), F.when(has_passage, F.col("ord"))).alias("passage"),
    )
    labels = F.concat(
        F.array(F.struct(F.lit("city").alias("kind"), text("place_name").alias("label"))),
        F.transform(items("themes"), lambda t: F.struct(F.lit("theme").alias("kind"), t.alias("label"))),
        F.transform(items("emotions"), lambda e: F.struct(F.lit("emotion").alias("kind"), e.alias("label"))),
    )

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("label"))))

    sets = (
        df.select("book_title", "author", F.inline(labels))
        .distinct()
        .groupBy("book_title", "author")
        .agg(of("city").alias("cities"), of("theme").alias("themes"), of("emotion").alias("emotions"))
    )
    same = [base["book_title"].eqNullSafe(sets["book_title"]), base["author"].eqNullSafe(sets["author"])]
    return base.join(sets, same).select(
        base["book_title"], base["author"], F.col("first.id").alias("id"), F.col("first.ord").alias("ord"),
        F.coalesce("first.genres", strings([])).alias("genres"), "entries", "passages", "passage",
        "cities", "themes", "emotions",
    )


def book_composite_text(books: DataFrame) -> DataFrame:
    """Text that stands for a book when it is embedded."""

    def joined(c: str, limit: int | None = None) -> Column:
        values = items(c) if limit is None else F.slice(items(c), 1, limit)
        return F.array_join(values, " ")

    parts = [
        F.lit("Title: "), text("book_title"), F.lit(". Author: "), text("author"), F.lit(". Genres: "), joined("genres"),
        F.lit(". Set in: "), joined("cities"), F.lit(". Themes: "), joined("themes", 5), F.lit(". Emotions: "),
        joined("emotions", 5), F.lit(". Context: "), F.left(text("passage"), F.lit(200)),
    ]
    return books.withColumn("composite_text", F.concat(*parts))


# ---- authors ----


def connection_counts(df: DataFrame) -> DataFrame:
    """Entries, distinct places and pairs of places of every author."""
    named = df.withColumn("author", text("author"))
    totals = named.groupBy("author").agg(F.count("*").alias("book_count"))
    n = named.select("author", "lon", "lat").distinct().groupBy("author").agg(F.count("*").alias("places"))
    pairs = (F.col("places") * (F.col("places") - 1) / 2).cast("bigint")
    return totals.join(n, "author").select("author", "book_count", "places", pairs.alias("connections"))


#: Buckets of one author, as long as a bucket holds what is asked for.
MOST_BUCKETS = 64


def author_connections(df: DataFrame, authors: Sequence[str] | DataFrame, bucket: int = 256) -> DataFrame:
    """Pairs of the distinct places of each listed author in list order, with the author's number of entries.

    Authors are a list, or a table with the column ``author``.

    The output grows with the square of an author's places, so authors are named, as on the map that shows them; see
    ``connection_counts`` for all.
    Repeated coordinates collapse first. An author's places are dealt into buckets of about
    ``bucket`` places and buckets are joined pairwise, so that even an author with very many places
    ("Unknown") is spread over many tasks. Beyond ``MOST_BUCKETS`` buckets they get larger, as each place is sent once for
    each of them; pairs themselves are not shuffled.
    """
    df = df.withColumn("author", text("author"))
    if isinstance(authors, DataFrame):
        df = df.join(authors.select(text("author").alias("author")).distinct(), "author", "left_semi")
    else:
        df = df.filter(F.col("author").isin(*authors))
    totals = df.groupBy("author").agg(F.count("*").alias("book_count"))
    unique = dedup_first(
        df.select("author", "lon", "lat", "place_name", "ord"), ["author", "lon", "lat"]
    )
    wide = F.greatest(F.lit(bucket), F.ceil(F.count("*") / F.lit(MOST_BUCKETS)))
    sized = unique.groupBy("author").agg(F.ceil(F.count("*") / wide).cast("int").alias("buckets")).join(totals, "author")
    dealt = unique.join(sized, "author").withColumn("b", F.pmod(F.xxhash64("ord"), F.col("buckets")).cast("int"))
    # every unordered pair of buckets (x <= y); each place meets each of them once
    all_buckets = F.sequence(F.lit(0), F.col("buckets") - 1)
    meetings = F.transform(
        all_buckets, lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y"))
    )
    met = dealt.select("author", "book_count", "lon", "lat", "place_name", "ord", "b", F.inline(meetings))
    fields = ("lon", "lat", "place_name", "ord", "b")
    left = met.select("author", "book_count", "x", "y", *[F.col(c).alias(f"source_{c}") for c in fields])
    right = met.select("author", "x", "y", *[F.col(c).alias(f"target_{c}") for c in fields])
    # places of one bucket pair up where the bucket meets itself, and only there
    own = (F.col("x") == F.col("y")) | (F.col("source_b") != F.col("target_b"))
    pairs = left.hint("merge").join(right, ["author", "x", "y"]).filter((F.col("source_ord") < F.col("target_ord")) & own)
    return pairs.select(
        "author",
        F.col("source_place_name").alias("source_city"), F.col("target_place_name").alias("target_city"),
        "source_lon", "source_lat", "target_lon", "target_lat", "source_ord", "target_ord", "book_count",
    )


def author_timeline(df: DataFrame, author: str | None = None, min_cities: int = 3) -> DataFrame:
    """Stops of an author's journey: first row of each (city, year), for authors with enough cities.

    ``step`` counts the stops by year and list order. It is the number of stops in earlier years
    plus the rank within the year, so that no author is ranked as one long group.
    """
    dated = df.filter(F.coalesce("publish_year", F.lit(0)) != 0).withColumn("author", text("author"))
    if author is not None:
        dated = dated.filter(F.col("author") == author)
    stops = dedup_first(dated, ["author", "place_name", "publish_year"])
    travelled = (
        stops.groupBy("author").agg(F.count_distinct("place_name").alias("cities")).filter(F.col("cities") >= min_cities)
    )
    stops = stops.join(travelled, "author")
    earlier = Window.partitionBy("author").orderBy("publish_year").rowsBetween(Window.unboundedPreceding, -1)
    per_year = stops.groupBy("author", "publish_year").agg(F.count("*").alias("n"))
    offsets = per_year.select("author", "publish_year", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_year = Window.partitionBy("author", "publish_year").orderBy("ord")
    ranked = stops.withColumn("_r", F.row_number().over(in_year))
    return (
        ranked.join(offsets, ["author", "publish_year"])
        .withColumn("step", F.col("before") + F.col("_r"))
        .drop("_r", "before")
    )


# ---- related works ----


def related_works(df: DataFrame, place_id: str, k: int = 8) -> DataFrame:
    """Best-scoring other entries for one entry, with up to two reasons.

    The chosen entry is one row, read as a scalar; the rest is one scan and a top-k.
    """
    fields = ("place_name", "region", "genres", "themes", "publish_year", "language")
    chosen = df.filter(F.col("id") == place_id).agg(F.min_by(F.struct(*fields), "ord")).scalar()
    rows = df.filter(F.col("id") != place_id).withColumn("_a", chosen).filter(F.col("_a").isNotNull())
    return _with_score(rows).orderBy(F.col("score").desc(), "ord").limit(k)


def _with_score(rows: DataFrame) -> DataFrame:
    """Score and reasons of rows against the entry in ``_a``; rows below the least score go."""
    a = F.col("_a")
    same_city = text("place_name") == F.coalesce(a["place_name"], F.lit(""))
    same_region = text("region") == F.coalesce(a["region"], F.lit(""))
    year = F.abs(F.coalesce("publish_year", F.lit(0)) - F.coalesce(a["publish_year"], F.lit(0)))
    language = F.coalesce(a["language"], F.lit(""))
    same_language = (text("language") == language) & (language != "English")
    # repeats within a row count, as each occurrence is compared
    rows = rows.withColumns(
        {
            "shared_genres": F.filter(items("genres"), lambda g: F.array_contains(items(a["genres"]), g)),
            "shared_themes": F.filter(items("themes"), lambda t: F.array_contains(items(a["themes"]), t)),
        }
    )
    n_genres, n_themes = F.size("shared_genres"), F.size("shared_themes")

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    score = (
        points(same_city, 3) + points(same_region & ~same_city, 1) + n_genres * 2 + n_themes * 2
        + points(year < 20, 1) + points(same_language, 2)
    )
    readable = F.transform(F.slice("shared_themes", 1, 2), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    reasons = F.array_compact(
        F.array(
            F.when(same_city, F.lit("Same city")),
            F.when(n_genres > 0, F.concat(F.lit("Shared: "), F.array_join(F.slice("shared_genres", 1, 2), ", "))),
            F.when(n_themes > 0, F.concat(F.lit("Themes: "), F.array_join(readable, ", "))),
            F.when(year < 20, F.lit("Similar era")),
            F.when(same_language, F.concat(F.lit("Both in "), text("language"))),
        )
    )
    return (
        rows.withColumn("score", score)
        .filter(F.col("score") >= 3)
        .withColumn("reasons", F.slice(reasons, 1, 2))
        .drop("_a", "shared_genres", "shared_themes")
    )


#: What a score is made of.
RELATED_FIELDS = ("place_name", "region", "genres", "themes", "publish_year", "language")
#: Least score of a related work, and the most that region and era, which bring no candidates, add together.
LEAST_SCORE, UNKEYED = 3, 2
#: Entries looked at for each key to find how well an entry's last result scores at least; the result does not depend on it.
TRIED = 64
#: Pairs that a task gathers before it cuts them to the first ones of each entry.
PAIRS_HELD = 1 << 16


def _score_keys(entries: DataFrame) -> DataFrame:
    """``entries`` with a row for each ``key``, what a pair must share to score, and the ``points`` this entry's share of it can bring."""

    def labels(c: str, kind: str) -> Column:
        return F.transform(
            F.array_distinct(c),
            lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x).alias("key"), (2 * F.size(F.filter(c, lambda y: y == x))).alias("points")),
        )

    def one(c: str, kind: str, points: int) -> Column:
        return F.array(F.struct(F.concat(F.lit(f"{kind}:"), F.col(c)).alias("key"), F.lit(points).alias("points")))

    spoken = F.when(F.col("language") != "English", one("language", "language", 2)).otherwise(F.array())
    keys = F.concat(one("place_name", "city", 3), labels("genres", "genre"), labels("themes", "theme"), spoken)
    keyed = entries.withColumn("_keys", F.filter(keys, lambda x: x["key"].isNotNull()))
    return keyed.select(*entries.columns, F.col("_keys.key").alias("own"), F.inline("_keys"))


def _first_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` profiles of each query, by score and list order; a task keeps no more of a query while pairs stream by."""

    def cut(batches: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(batches)
        t = t.take(pc.sort_indices(t, [("qid", "ascending"), ("score", "descending"), ("ord", "ascending")], null_placement="at_start"))
        q = t["qid"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        return t.filter(pa.array(np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, PAIRS_HELD
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > most:
                held = cut(held).combine_chunks().to_batches()
                n = sum(b.num_rows for b in held)
                most = 2 * n + PAIRS_HELD
        if held:
            yield from cut(held).to_batches(max_chunksize=PAIRS_HELD)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return top_k_per_group(pairs.mapInArrow(first, kinds), ["qid"], [F.col("score").desc(), "ord"], k)


def related_works_of(df: DataFrame, asked: DataFrame, k: int = 8, salts: int = 8) -> DataFrame:
    """``related_works`` for a set of entries (column ``id``): query_id, rank, id, ord, score, reasons.

    Rows alike in all that counts are one profile, with its first ``k + 1`` rows in list order; so copies are scored once.
    A pair of profiles can only reach the least score if it shares city, genre, theme or language. A few profiles of each
    key, scored first, say what an entry's last result scores at least. Its most frequent keys that together cannot
    reach that bring no candidates; the others meet the profiles that have them, dealt to ``salts``, as a key may be hot.
    Fields travel with the keys: a pair is scored where it meets on the rarest key it shares, and a task keeps the first
    ``k + 1`` of each entry, so pairs are neither gathered nor shuffled. The bound only leaves out what cannot be among
    the first ``k``. An id that is not there, or null, gives no row.
    """
    rows = df.select(
        "id", "ord", *[text(c).alias(c) for c in ("place_name", "region", "language")], *[items(c).alias(c) for c in ("genres", "themes")],
        F.coalesce("publish_year", F.lit(0)).alias("publish_year"),
    )
    fields = list(RELATED_FIELDS)
    first = materialise(top_k_per_group(rows, fields, ["ord"], k + 1), "first-rows")
    profiles = materialise(first.filter("rank = 1").select(F.monotonically_increasing_id().alias("pid"), "ord", *fields), "profiles")
    first = first.join(profiles.drop("ord"), fields).select("pid", "id", "ord")
    chosen = dedup_first(rows.join(asked.select("id").distinct(), "id", "left_semi"), ["id"]).drop("ord")
    queries = materialise(chosen.join(profiles, fields).select(F.col("id").alias("query_id"), F.col("pid").alias("qid")), "queries")
    whole = queries.select("qid").distinct().join(profiles.drop("ord").withColumnRenamed("pid", "qid"), "qid").select("qid", F.struct(*fields).alias("_a"))

    keys = materialise(_score_keys(profiles.select("pid", "ord", *fields)).select("pid", "ord", "key", "points"), "keys")
    frequency = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("points").alias("most"))
    wanted = keys.join(queries.select(F.col("qid").alias("pid")).distinct(), "pid", "left_semi").select(F.col("pid").alias("qid"), "key")
    frequent = Window.partitionBy("qid").orderBy(F.col("n").desc(), "key")
    # the keys up to here, and all that need no key, fall short of what they do not reach
    wanted = wanted.join(frequency, "key").select(
        "qid", "key", (F.sum("most").over(frequent) + UNKEYED).alias("reach"),
        F.collect_list("key").over(frequent.rowsBetween(1, Window.unboundedFollowing)).alias("rarer"),
    )
    wanted = materialise(wanted.join(whole, "qid"), "asked-keys")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def dealt(number: str) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(salts)).cast("int").alias("salt")

    def scored(asking: DataFrame, having: DataFrame) -> DataFrame:
        met = asking.join(having, ["key", "salt"]).filter(~F.arrays_overlap("rarer", "own"))
        return _with_score(met)

    few = top_k_per_group(keys, ["key"], ["ord", "pid"], TRIED).groupBy("pid").agg(F.collect_list("key").alias("own"))
    few = profiles.join(few, "pid").withColumn("key", F.explode("own")).select("*", every)
    tried = scored(wanted.select("*", dealt("qid")), few).select("qid", "pid", "ord", "score")
    least = _first_pairs(tried, k + 1).filter(F.col("rank") == k + 1)
    least = materialise(least.select("qid", F.col("score").alias("least"), F.col("ord").alias("least_ord")), "least")

    bounded = wanted.join(least, "qid", "left").filter(F.col("reach") >= F.coalesce("least", F.lit(LEAST_SCORE))).select("*", every)
    found = scored(bounded, _score_keys(profiles).select("*", dealt("pid")))
    as_early = F.col("ord").isNull() | (F.col("ord") <= F.col("least_ord"))
    found = found.filter(F.col("least").isNull() | (F.col("score") > F.col("least")) | ((F.col("score") == F.col("least")) & as_early))
    # the first rows are rows of the first profiles
    best = _first_pairs(found.select("qid", "pid", "ord", "score"), k + 1).select("qid", "pid")
    best = _with_score(best.join(whole, "qid").join(profiles.drop("ord"), "pid")).select("qid", "pid", "score", "reasons")
    best = top_k_per_group(best.join(first, "pid"), ["qid"], [F.col("score").desc(), "ord"], k + 1).drop("rank")
    others = queries.join(best, "qid").filter(F.col("query_id") != F.col("id"))
    return top_k_per_group(others, ["query_id"], [F.col("score").desc(), "ord"], k).select("query_id", "rank", "id", "ord", "score", "reasons")


# ---- research ledger ----


def ledger_summary(df: DataFrame) -> DataFrame:
    """Totals of a review ledger: places per row, record types, coverage."""

    def n_type(kind: str) -> Column:
        return F.count_if(F.col("record_type") == kind).alias(f"{kind}_rows")

    reviewed = F.count_if(F.col("status") == "reviewed")
    return df.agg(
        F.count("*").alias("total_rows"),
        reviewed.alias("reviewed_rows"),
        F.coalesce(F.try_divide(reviewed, F.count("*")), F.lit(0.0)).alias("reviewed_coverage_rate"),
        F.count_if(F.size("places") <= 1).alias("single_place_rows"),
        F.count_if(F.size("places") > 1).alias("multi_place_rows"),
        n_type("unknown"), n_type("fictional"), n_type("nonfiction"), n_type("narrative"),
    )


def ledger_counts(df: DataFrame, columns: Sequence[str] = ("record_type", "system_tier")) -> DataFrame:
    """Long table (counter, value, entries), from one pass."""
    entries = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(entries)).groupBy("counter", "value").agg(F.count("*").alias("entries"))


def with_lenient_tier(df: DataFrame) -> DataFrame:
    return ensure(df, "quality_tier", "place_granularity").withColumn("quality_tier", tier_lenient())
