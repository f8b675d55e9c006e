"""Choice of rows for enrichment: scores, region quotas, diverse selection."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import strip, text
from tomeatlas.operators.dedup import top_k_per_group, with_book_key, with_row_key
from tomeatlas.plans.scratch import materialise
from tomeatlas.schema import ensure

# Weights of the scores, smallest quota, size of the inspected head of a pool.
FLOOR = 15
HEAD_FACTOR, HEAD_MIN = 6, 400


def unenriched(df: DataFrame) -> DataFrame:
    df = ensure(df, "enrichment_method")
    return df.filter(F.coalesce(F.nullif("enrichment_method", F.lit("")), F.lit("none")) == "none")


def minmax(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each column scaled to 0..1 over the dataset under its new name, 0 when it does not vary; one pass for all spans."""
    spans = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(out) for c, out in columns.items()])).scalar()
    scaled = df.withColumn("_span", spans)
    for c, out in columns.items():
        lo, hi = F.col(f"_span.{out}.lo"), F.col(f"_span.{out}.hi")
        scaled = scaled.withColumn(out, F.coalesce(((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0))).cast("double"), F.lit(0.0)))
    return scaled.drop("_span")


def enrichment_score(df: DataFrame, editions: DataFrame) -> DataFrame:
    """Base score from edition counts (title_key, author_key, edition_count) and author prominence."""
    df = ensure(with_row_key(with_book_key(df)), "country")
    authors = df.groupBy("author_key").agg(
        F.count("*").alias("_rows"), F.count_distinct("title_key").alias("_titles")
    )
    canon = F.log1p("_rows") * 0.6 + F.log1p("_titles") * 0.4
    scored = (
        df.join(authors.select("author_key", canon.alias("canon_raw")), "author_key")
        .join(editions.groupBy("title_key", "author_key").agg(F.max("edition_count").alias("edition_count")), ["title_key", "author_key"], "left")
        .withColumns(
            {
                "edition_count": F.coalesce("edition_count", F.lit(0)),
                "passage_bonus": F.when(strip("passage") != "", F.lit(0.15)).otherwise(F.lit(0.0)),
                "region": F.coalesce(F.nullif("region", F.lit("")), F.lit("Unknown")),
                "country": F.coalesce(F.nullif("country", F.lit("")), F.lit("Unknown")),
            }
        )
    )
    scored = materialise(scored, "scored")  # the spans and the rows share one computation of the joins
    scored = minmax(scored, {"edition_count": "edition_score", "canon_raw": "canon_score"})
    base = F.col("edition_score") * 0.72 + F.col("canon_score") * 0.28 + F.col("passage_bonus")
    return scored.withColumn("base_score", base).drop("title_key", "author_key")


# ---- quotas ----


def _spread(room: np.ndarray, amount: int) -> np.ndarray:
    """Deal ``amount`` out one by one, round after round, to entries that still have room."""
    low, high = 0, int(room.max(initial=0))
    while low < high:
        mid = (low + high + 1) // 2
        if np.minimum(room, mid).sum() <= amount:
            low = mid
        else:
            high = mid - 1
    given = np.minimum(room, low)
    rest = int(amount - given.sum())
    extra = np.flatnonzero(room > low)[:rest]
    given[extra] += 1
    return given


def allocate(sizes: pd.Series, limit: int) -> pd.Series:
    """Quota per region, proportional to the square root of its share, adjusted to the limit."""
    sizes = sizes.sort_index()
    size = sizes.to_numpy(dtype=np.int64)
    target = min(limit, int(size.sum()))
    weight = np.sqrt(size / max(size.sum(), 1))
    quota = np.floor(limit * (weight / max(weight.sum(), 1e-9))).astype(np.int64)
    quota = np.minimum(np.maximum(quota, FLOOR), size)

    def shave(floor: int) -> None:
        excess = int(quota.sum()) - target
        if excess > 0:
            order = np.argsort(-quota, kind="stable")
            room = np.maximum(quota[order] - floor, 0)
            quota[order] -= _spread(room, min(excess, int(room.sum())))

    shave(FLOOR)
    shave(0)
    missing = target - int(quota.sum())
    if missing > 0:
        order = np.argsort(-(size - quota), kind="stable")
        quota[order] += _spread((size - quota)[order], missing)
    return pd.Series(quota, index=sizes.index)


def region_quotas(df: DataFrame, limit: int) -> DataFrame:
    """(region, rows, quota): counted in Spark, adjusted on the one-row-per-region table."""
    counts = df.groupBy("region").agg(F.count("*").alias("rows"))

    def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
        quota = allocate(pdf.set_index("region")["rows"], limit)
        return pdf.assign(quota=pdf["region"].map(quota))

    return counts.groupBy().applyInPandas(adjust, "region string, rows bigint, quota bigint")


# ---- diverse selection ----


#: What a first row of a new region, country or place adds to its score; the n-th adds a part of n.
BONUS = {"region": 0.22, "country": 0.12, "place_name": 0.10}


def _pick(pool: pd.DataFrame, budget: int, seen: dict[str, Counter]) -> list[tuple[int, float]]:
    """Greedy choice from one region's pool, best base score first, with bonuses for labels not chosen yet.

    Rows of one country and place have the same bonus, so only the first one left of each such group can be next. A
    row comes into view when fewer than the inspected head of rows before it are left.
    """
    head, base = max(budget * HEAD_FACTOR, HEAD_MIN), pool["base_score"].to_numpy()
    queues = {g: iter(rows[1:]) for g, rows in pool.groupby(["country", "place_name"], sort=False, dropna=False).indices.items()}
    firsts = pool.groupby(["country", "place_name"], sort=False, dropna=False).indices
    names = list(queues)
    front = np.array([firsts[g][0] for g in names])
    region = pool["region"].iloc[0]
    chosen: list[tuple[int, float]] = []
    while len(chosen) < min(budget, len(pool)):
        bonus = BONUS["region"] / (1 + seen["region"][region])
        bonus = bonus + np.array([BONUS["country"] / (1 + seen["country"][c]) for c, _ in names])
        bonus = bonus + np.array([BONUS["place_name"] / (1 + seen["place_name"][p]) for _, p in names])
        in_view = front < min(head + len(chosen), len(pool))
        score = np.where(in_view, base[np.minimum(front, len(pool) - 1)] + bonus, -np.inf)
        best = np.flatnonzero(score == score.max())
        g = best[np.argmin(front[best])]
        row = int(front[g])
        chosen.append((row, float(score[g])))
        front[g] = next(queues[names[g]], len(pool))
        for c, label in zip(BONUS, (region, *names[g])):
            seen[c][label] += 1
    return chosen


def select_diverse(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows to enrich, spread over regions, countries and places.

    Picking is sequential, but a region's turn only ever looks at its best
    max(6 quota, 400) + quota rows. These heads are cut in Spark; what reaches the single picking
    task is bounded by ``limit`` alone, however many rows there are, and a pick looks at one row of each group of
    country and place among them. ``limit`` thus bounds the task's work as well.
    """
    quotas = region_quotas(scored, limit)
    slim = scored.select("ord", "row_key", "id", "region", "country", text("place_name").alias("place_name"), "base_score")
    deepest = max(limit * HEAD_FACTOR, HEAD_MIN) + limit
    heads = top_k_per_group(slim, ["region"], [F.col("base_score").desc(), F.col("ord")], deepest)
    need = F.greatest(F.col("quota") * HEAD_FACTOR, F.lit(HEAD_MIN)) + F.col("quota")
    heads = heads.join(quotas, "region").filter((F.col("quota") > 0) & (F.col("rank") <= need))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = {"region": Counter(), "country": Counter(), "place_name": Counter()}
        out = []
        for _, pool in pdf.sort_values(["region", "rank"]).groupby("region", sort=True):
            pool = pool.reset_index(drop=True)
            for row, score in _pick(pool, int(pool["quota"].iloc[0]), seen):
                r = pool.iloc[row]
                out.append((len(out) + 1, r["ord"], r["row_key"], r["id"], r["region"], r["country"], r["place_name"], r["base_score"], score))
        columns = ["pick", "ord", "row_key", "id", "region", "country", "place_name", "base_score", "final_score"]
        return pd.DataFrame(out, columns=columns)

    schema = (
        "pick int, ord bigint, row_key string, id string, region string, country string, place_name string, "
        "base_score double, final_score double"
    )
    return heads.groupBy().applyInPandas(choose, schema)


