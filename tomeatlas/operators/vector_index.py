"""Inverted-file index over embeddings: every row in the list of its nearest centroid, queries look into a few lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.operators.dedup import top_k_per_group
from tomeatlas.operators.vectors import _neighbours, _unit, nearest_vectors
from tomeatlas.plans.scratch import materialise

#: Most lists, rows that centroids are fitted on, and rounds of fitting. All three bound what the driver holds.
MOST_LISTS, SAMPLE, ROUNDS = 4096, 65_536, 12
#: Queries that the number of lists to look into is measured with, and the share of their neighbours to be found.
MEASURED, RECALL = 200, 0.95


def fit_centroids(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means on at most ``sample`` rows (ord, embedding) drawn by a hash of ``ord``.

    Without ``lists`` there are as many as the square root of the number of rows, 4096 at most.
    """
    n = corpus.count()
    lists = lists or max(1, min(MOST_LISTS, int(n**0.5)))
    drawn = corpus.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(F.lit(seed), "ord")).limit(sample).select("embedding")
    x = _unit(drawn.toPandas()["embedding"]) if n else np.zeros((0, 1))
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = (size[:, 0] == 0).nonzero()[0]
        centres = np.divide(sums, size, out=centres.copy(), where=size > 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def _lists(centres: np.ndarray, most: int):
    """The nearest lists of a vector, best first."""

    def near(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        scores = _unit(vectors) @ centres.T
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return F.pandas_udf(near, "array<int>")


def vector_index(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row (ord, embedding) with the number of its list, written once; rows without embedding are left out."""
    rows = corpus.select("ord", "embedding").where(F.col("embedding").isNotNull())
    return materialise(rows.withColumn("list", _lists(centres, 1)("embedding")[0]), "vector-index")


def probes_for(corpus: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 6, recall: float = RECALL, queries: int = MEASURED) -> int:
    """Into how many lists a query must look, so that ``recall`` of the k nearest rows are found.

    Measured on ``queries`` rows drawn by a hash, whose exact neighbours are found over the whole corpus. Clustered data
    needs a few lists, vectors without structure may need most.
    """
    drawn = materialise(corpus.select("ord", "embedding").where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(F.lit(11), "ord")).limit(queries), "measured")
    order = drawn.select("ord", F.posexplode(_lists(centres, len(centres))("embedding")).alias("place", "list"))
    true = nearest_vectors(drawn, corpus.where(F.col("embedding").isNotNull()), k, -2.0)
    met = true.join(index.select(F.col("ord").alias("other"), "list"), "other").join(order, ["ord", "list"])
    found = dict(met.groupBy("place").agg(F.count("*").alias("n")).collect())  # a row for each place at most
    below = np.cumsum([found.get(i, 0) for i in range(len(centres))])
    return int(np.searchsorted(below, recall * below[-1])) + 1 if below[-1] else len(centres)


def indexed_neighbours(
    queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int, k: int = 6, floor: float = 0.4, query_rows: int = 4096, part_rows: int = 16_384
) -> DataFrame:
    """Approximate (ord, other, score, rank): the best of the rows in the ``probes`` lists nearest to each query.

    Scores are exact, and rows that lie in other lists are missed; all lists as probes give the exact answer. A list with
    more rows, or more queries, than a task should hold is dealt into parts and blocks that meet once each, so a list with a
    large share of all rows is many tasks. Each keeps k rows for a query.
    """
    asked = queries.select("ord", "embedding").where(F.col("embedding").isNotNull()).withColumn("list", F.explode(_lists(centres, min(probes, len(centres)))("embedding")))
    asked = materialise(asked, "probes")
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))
    grid = materialise(parts.join(blocks, "list"), "grid")  # a row for each list
    by = F.xxhash64("ord")
    one = asked.join(grid, "list").select("ord", "embedding", "list", F.lit(True).alias("asked"), F.pmod(by, "blocks").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"))
    two = index.join(grid, "list").select("ord", "embedding", "list", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.pmod(by, "parts").cast("int").alias("y"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, known = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        out = _neighbours(mine, known, k, floor) if len(mine) and len(known) else []
        empty = pd.DataFrame({"ord": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out) if out else empty

    best = one.unionByName(two).groupBy("list", "x", "y").applyInPandas(multiply, "ord bigint, other bigint, score double")
    return top_k_per_group(best, ["ord"], [F.col("score").desc(), F.col("other")], k)
