"""First-wins and best-wins de-duplication, top rows per group, set operations on datasets.

Groups are never gathered whole: rows are ranked in salted sub-groups first, so a hot group is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeatlas.functions.expr import items, strip, text
from tomeatlas.functions.text import norm_text
from tomeatlas.schema import ensure


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    For every ``k`` the rows of a group are dealt to ``salts`` sub-groups by where the scan met them, and cut to ``k``
    there; the last ranking sees at most ``salts * k`` rows of a group. Ties are broken by the order alone.
    """
    order = list(order)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= k).drop("_r", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ("ord",)) -> DataFrame:
    """The first row of each key in list order; Spark cuts the ranks before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).filter(F.col("_first") == 1).drop("_first")


def with_book_key(df: DataFrame) -> DataFrame:
    """Normalised title and author, the identity of a work."""
    return df.withColumns({"title_key": norm_text("book_title"), "author_key": norm_text("author")})


def dedup_best(df: DataFrame, order: Sequence[str] = ("ord",)) -> tuple[DataFrame, DataFrame]:
    """Best row per normalised (title, author, place), and the rows it displaces.

    Best: most themes, then emotions, longer passage, a cover, earlier in the list.
    """
    df = ensure(df, "cover_url")
    keys = ["title_key", "author_key", "place_key"]
    tagged = with_book_key(df).withColumn("place_key", norm_text("place_name"))
    best_first = [
        F.size(items("themes")).desc(),
        F.size(items("emotions")).desc(),
        F.length(strip("passage")).desc(),
        (text("cover_url") != "").desc(),
        *[F.col(c).asc_nulls_first() for c in order],
    ]
    kept = dedup_first(tagged, keys, best_first).select(*df.columns)
    winners = kept.select(*order)
    same = [df[c].eqNullSafe(winners[c]) for c in order]
    removed = df.join(winners, same, "left_anti")
    return kept, removed


def union_entries(*dfs: DataFrame) -> DataFrame:
    """Concatenation of datasets whose columns differ."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows where the predicate does not hold, and rows where it does."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def select_keys(df: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Rows whose key is listed."""
    wanted = keys.select(F.col(keys.columns[0]).alias(by)).distinct()
    return df.join(wanted, by, "left_semi")


def pending(df: DataFrame, processed: DataFrame, by: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    done = processed.select(F.col(by)).distinct()
    return df.join(done, by, "left_anti")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ord",)) -> DataFrame:
    """Incoming rows with a key unknown so far, first of each key."""
    known = existing.select(*keys).distinct()
    return dedup_first(incoming, keys, list(order)).join(known, list(keys), "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, columns: Sequence[str] = ("book_title", "author")) -> DataFrame:
    """Existing rows followed by incoming ones whose normalised columns are new."""
    names = [f"_key{i}" for i in range(len(columns))]
    norm = {n: norm_text(c) for n, c in zip(names, columns)}
    fresh = new_rows(existing.withColumns(norm), incoming.withColumns(norm), names).drop(*names)
    return union_entries(existing, fresh)


def with_row_key(df: DataFrame) -> DataFrame:
    """Key that stays unique where ids repeat: position and id."""
    return df.withColumn("row_key", F.concat_ws(":", F.col("ord").cast("string"), text("id")))
