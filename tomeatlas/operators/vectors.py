"""Embedding search: similar works, query vectors, spatial and semantic rank combined."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import items
from tomeatlas.functions.geo import haversine
from tomeatlas.operators.dedup import top_k_per_group
from tomeatlas.operators.spatial import in_box

#: Queries and corpus rows whose scores a task holds at a time.
_TILE, _CHUNK = 1024, 4096
#: Blocks of queries and parts of the corpus grow beyond the asked sizes when there would be more than these, up to so many rows.
MOST_BLOCKS, MOST_PARTS, BLOCK_ROWS, PART_ROWS = 4, 64, 16_384, 16_384


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def cosine_to(vector: Sequence[float]):
    """Cosine of an array column with a constant vector, one matrix product per Arrow batch."""
    q = np.asarray(vector, dtype=np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-300)

    @F.pandas_udf("double")
    def cosine(vectors: pd.Series) -> pd.Series:
        return pd.Series(_unit(vectors) @ q) if len(vectors) else pd.Series([], dtype="float64")

    return cosine


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k largest entries per row, ties to the left."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    bound = np.take_along_axis(scores, top, axis=1).min(axis=1)
    tied = (scores >= bound[:, None]).sum(axis=1) > k
    if tied.any():
        top[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return top


def _neighbours(a: pd.DataFrame, b: pd.DataFrame, k: int, floor: float) -> list[pd.DataFrame]:
    """Best k rows of ``b`` for every row of ``a``, tile by tile; a tile's scores with ``_CHUNK`` rows of ``b`` are held at a time."""
    out = []
    b = b.sort_values("ord")
    b_ord, b_unit = b["ord"].to_numpy(), _unit(b["embedding"])
    for start in range(0, len(a), _TILE):
        tile = a.iloc[start : start + _TILE]
        ids, unit = tile["ord"].to_numpy(), _unit(tile["embedding"])
        value, other = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), b_ord.dtype)
        for at in range(0, len(b_ord), _CHUNK):
            known = b_ord[at : at + _CHUNK]
            scores = unit @ b_unit[at : at + _CHUNK].T
            scores[ids[:, None] == known[None, :]] = -np.inf
            top = _best(scores, k)
            value = np.concatenate([value, np.take_along_axis(scores, top, axis=1)], axis=1)
            other = np.concatenate([other, known[top]], axis=1)
            first = np.lexsort((other, -value))[:, :k]
            value, other = np.take_along_axis(value, first, axis=1), np.take_along_axis(other, first, axis=1)
        row, rank = np.nonzero(value > floor)
        out.append(pd.DataFrame({"ord": ids[row], "other": other[row, rank], "score": value[row, rank]}))
    return out


def nearest_vectors(
    queries: DataFrame, corpus: DataFrame, k: int = 6, floor: float = 0.4, query_rows: int = 16_384, part_rows: int = 65_536
) -> DataFrame:
    """Exact (ord, other, score, rank) of the k rows of ``corpus`` most similar to each query, itself left out, with a
    cosine above ``floor``.

    Queries are a stated set, dealt into blocks of about ``query_rows`` by hash; the corpus is dealt into parts of about
    ``part_rows`` and read once for each block. A task multiplies one block with one part as matrices and emits at
    most k rows per query; pairs are never written out. Where that would make more than ``MOST_BLOCKS`` blocks or
    ``MOST_PARTS`` parts, they get larger, up to ``BLOCK_ROWS`` and ``PART_ROWS``, so that a row is not sent ever more often.
    """
    q, c = queries.select("ord", "embedding"), corpus.select("ord", "embedding")

    def pieces(df: DataFrame, rows: int, most: int, largest: int) -> Column:
        n = F.count("*")
        wide = F.greatest(F.least(F.ceil(n / F.lit(most)), F.lit(largest)), F.least(F.lit(rows), F.lit(largest)))
        return F.greatest(df.agg(F.ceil(n / wide).cast("int")).scalar(), F.lit(1))

    blocks, parts = pieces(q, query_rows, MOST_BLOCKS, BLOCK_ROWS), pieces(c, part_rows, MOST_PARTS, PART_ROWS)

    def dealt(df: DataFrame, asked: bool) -> DataFrame:
        x, y = F.pmod(F.xxhash64("ord"), blocks), F.pmod(F.xxhash64("ord"), parts)
        everywhere = F.explode(F.sequence(F.lit(0), (parts if asked else blocks) - 1))
        pair = (x.cast("int").alias("x"), everywhere.alias("y")) if asked else (everywhere.alias("x"), y.cast("int").alias("y"))
        return df.select("ord", "embedding", F.lit(asked).alias("asked"), *pair)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, known = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        out = _neighbours(asked, known, k, floor) if len(asked) and len(known) else []
        empty = pd.DataFrame({"ord": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out) if out else empty

    met = dealt(q, True).unionByName(dealt(c, False))
    best = met.groupBy("x", "y").applyInPandas(multiply, "ord bigint, other bigint, score double")
    return top_k_per_group(best, ["ord"], [F.col("score").desc(), F.col("other")], k)


def similar_works(wanted: DataFrame, books: DataFrame, k: int = 6, floor: float = 0.4) -> DataFrame:
    """Per wanted book (ord) the most similar other ``books`` (ord, book_title, author, themes, embedding)."""
    asked = books.select("ord", "embedding").join(wanted.select("ord").distinct(), "ord", "left_semi")
    near = nearest_vectors(asked, books, k, floor)
    mine = books.select("ord", "book_title", "author", F.col("themes").alias("_mine"))
    theirs = books.select(
        F.col("ord").alias("other"), F.col("book_title").alias("similar_title"), F.col("author").alias("similar_author"),
        F.col("themes").alias("_theirs"),
    )
    shared = F.slice(F.array_sort(F.array_intersect(items("_mine"), items("_theirs"))), 1, 2)
    return (
        near.join(mine, "ord")
        .join(theirs, "other")
        .select(
            "ord", "book_title", "author", "rank", "other", "similar_title", "similar_author",
            F.round("score", 3).alias("score"), shared.alias("shared_themes"),
        )
    )


def semantic_search(passages: DataFrame, vector: Sequence[float], k: int = 10, threshold: float = 0.7) -> DataFrame:
    """Passages more similar to a query vector than ``threshold``, best first."""
    return (
        passages.withColumn("similarity", cosine_to(vector)("embedding"))
        .filter(F.col("similarity") > threshold)
        .orderBy(F.col("similarity").desc(), "ord")
        .limit(k)
    )


def hybrid_search(
    passages: DataFrame, vector: Sequence[float], lon: float, lat: float, radius_m: float = 100_000, k: int = 20
) -> DataFrame:
    """Passages within the radius by 60 % similarity and 40 % proximity."""
    near = passages.filter(in_box(lon, lat, radius_m)).withColumn(
        "distance_m", haversine(F.lit(lon), F.lit(lat), "lon", "lat")
    )
    near = near.filter(F.col("distance_m") <= radius_m).withColumn("similarity", cosine_to(vector)("embedding"))
    proximity: Column = F.lit(1.0) - F.least(F.col("distance_m") / radius_m, F.lit(1.0))
    return (
        near.withColumn("combined_score", F.col("similarity") * 0.6 + proximity * 0.4)
        .orderBy(F.col("combined_score").desc(), "ord")
        .limit(k)
    )
