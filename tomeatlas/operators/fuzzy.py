"""Fuzzy match of many query strings at once: trigram sets counted block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import text
from tomeatlas.functions.trigram import trigrams
from tomeatlas.operators.dedup import top_k_per_group
from tomeatlas.plans.scratch import materialise

NAMES = ("book_title", "author", "place_name")
#: Blocks of queries and parts of names that tables are dealt into at most, as long as these stay below the largest size.
MOST_BLOCKS, MOST_PARTS = 4, 16
BLOCK_ROWS, PART_ROWS = (1_024, 32_768), (8_192, 131_072)
#: Trigrams that more than one in so many names of a part have are kept as a row of flags.
OFTEN = 16
#: Pairs that a task holds until it sends on a batch, and gathers of some queries from all parts.
PAIRS, GATHERED = 1 << 16, 1 << 18
PAIR = ("qid", "vid", "similarity", "owner")


def _numbers(grams: Column) -> Column:
    """Each trigram as one number: its three code points."""
    return F.transform(grams, lambda g: F.ascii(g).cast("bigint") * (1 << 42) + F.ascii(F.substring(g, 2, 1)).cast("bigint") * (1 << 21) + F.ascii(F.substring(g, 3, 1)))


class _Part:
    """Names of one part, in the order of their ids, by trigram."""

    def __init__(self, ids: np.ndarray, owners: np.ndarray, sets: tuple[np.ndarray, np.ndarray]):
        flat, self.size = sets
        row = np.argsort(ids, kind="stable")
        place = np.empty_like(row)
        place[row] = np.arange(len(row))
        of = np.repeat(place, self.size)
        self.ids, self.owners, self.size = ids[row], owners[row], self.size[row]
        by = np.argsort(flat, kind="stable")
        self.gram, starts = np.unique(flat[by], return_index=True)
        self.post, self.starts = of[by], np.append(starts, len(flat))
        often = np.flatnonzero(np.diff(self.starts) * OFTEN > len(ids))
        self.flags = {}
        for g in often.tolist():
            flags = self.flags[g] = np.zeros(len(ids), np.uint8)
            flags[self.post[self.starts[g] : self.starts[g + 1]]] = 1

    def alike(self, grams: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Names (as places in the part) whose similarity with a set reaches the threshold, and the similarities."""
        at = np.searchsorted(self.gram, grams)
        at = at[np.take(self.gram, at, mode="clip") == grams]
        shared = np.zeros(len(self.ids), np.uint8 if len(grams) < 256 else np.int32)
        for g in at.tolist():
            if g in self.flags:
                shared += self.flags[g]
            else:  # a name is there once at most
                shared[self.post[self.starts[g] : self.starts[g + 1]]] += 1
        found = np.flatnonzero(shared >= max(int(np.ceil(threshold * len(grams) - 1e-9)), 1))
        both = shared[found].astype(np.int64)
        similarity = both / (len(grams) + self.size[found] - both)
        enough = similarity >= threshold
        return found[enough], similarity[enough]


def _best(pairs: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Of all pairs of some queries those that may bring one of the first k owners: with fewer than k owners of the query before them."""
    order = np.lexsort((pairs["vid"], -pairs["similarity"], pairs["qid"]))
    pairs = {c: x[order] for c, x in pairs.items()}
    query, owner = pairs["qid"], pairs["owner"]
    by = np.lexsort((np.arange(len(query)), owner, query))
    new = np.ones(len(query), np.int64)
    new[by[1:]] = (query[by][1:] != query[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    before = np.cumsum(new) - new
    before -= before[np.searchsorted(query, query)]
    return {c: x[before < k] for c, x in pairs.items()}


def _sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The trigram numbers of all rows, one after the other, and how many each row has."""
    grams = rows["grams"].combine_chunks()
    return grams.flatten().to_numpy(), grams.value_lengths().to_numpy().astype(np.int64)


def _matched(rows: pa.Table, threshold: float, k: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a block of queries with a part of names."""
    asked = rows["asked"].to_numpy()
    wanted, known = rows.filter(pa.array(asked)), rows.filter(pa.array(~asked))
    if not len(wanted) or not len(known):
        return
    part = _Part(known["id"].to_numpy(), known["owner"].to_numpy(), _sets(known))
    flat, size = _sets(wanted)
    ends = np.cumsum(size)
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        pairs = {c: np.concatenate(x) for c, x in zip(PAIR, zip(*out))}
        return pa.record_batch(pairs if k is None else _best(pairs, k))

    for qid, first, last in zip(wanted["id"].to_numpy().tolist(), (ends - size).tolist(), ends.tolist()):
        found, similarity = part.alike(flat[first:last], threshold)
        out.append((np.full(len(found), qid), part.ids[found], similarity, part.owners[found]))
        held += len(found)
        if held >= PAIRS:
            yield batch()
            out, held = [], 0
    if held:
        yield batch()


def similar_strings(asked: DataFrame, names: DataFrame, threshold: float = 0.3, k: int | None = None, order: str = "ord") -> DataFrame:
    """(query, value, similarity) of all pairs of different strings (columns ``value``) whose trigram similarity reaches the threshold.

    With ``k``, each name also has ``order``, the first row that has it, and pairs that cannot bring a query one of its first
    ``k`` rows, by similarity and ``order``, may be left out: k other rows come before.

    Every string is taken apart once, into numbers. Queries are dealt into blocks and names into parts; each block meets each
    part in one task, which counts shared trigrams by the lists of names that have one, and as flags for frequent ones. So
    no pair is sent before it is verified; with ``k``, a part sends few pairs of each query, and those of all parts are cut
    again. Memory is bounded by the sizes of a block and a part; time still grows with queries times names.
    """
    owner = F.xxhash64(order) if k is not None else F.lit(0).cast("bigint")
    sets = F.col("value"), _numbers(trigrams("value")).alias("grams")
    listed = (names.select("value").distinct() if k is None else names.orderBy(order)).select(F.monotonically_increasing_id().alias("id"), owner.alias("owner"), *sets)
    wanted = asked.select("value").distinct().select(F.monotonically_increasing_id().alias("id"), F.lit(0).cast("bigint").alias("owner"), *sets)
    known, wanted = [materialise(s, name).where(F.size("grams") > 0) for s, name in ((listed, "names"), (wanted, "queries"))]

    def pieces(df: DataFrame, rows: tuple[int, int], most: int) -> int:
        n = df.count()
        return max(-(-n // min(max(-(-n // most), rows[0]), rows[1])), 1)

    blocks, parts = pieces(wanted, BLOCK_ROWS, MOST_BLOCKS), pieces(known, PART_ROWS, MOST_PARTS)

    def dealt(df: DataFrame, is_asked: bool) -> DataFrame:
        own, others = (blocks, parts) if is_asked else (parts, blocks)
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("id", "owner", "grams", F.lit(is_asked).alias("asked"), *((mine.alias("x"), each.alias("y")) if is_asked else (each.alias("x"), mine.alias("y"))))

    met = dealt(wanted, True).unionByName(dealt(known, False)).repartition(min(blocks * parts, 4_096), "x", "y")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matched(pa.Table.from_batches(batches), threshold, k)

    def first(rows: pa.Table) -> pa.Table:
        return pa.table(_best({c: rows[c].to_numpy() for c in PAIR}, k))

    found = met.groupBy("x", "y").applyInArrow(match, kinds := "qid bigint, vid bigint, similarity double, owner bigint")
    if k is not None and parts > 1:
        some = -(-wanted.count() * parts * k // GATHERED)
        bucket = F.pmod(F.xxhash64("qid"), F.lit(some)).alias("x")
        found = found.select(*PAIR, bucket).repartition(min(some, 4_096), "x").groupBy("x").applyInArrow(first, kinds)
    said = wanted.select(F.col("id").alias("qid"), F.col("value").alias("query")), known.select(F.col("id").alias("vid"), "value")
    return found.join(said[0], "qid").join(said[1], "vid").select("query", "value", "similarity")


def fuzzy_join(df: DataFrame, queries: DataFrame, k: int = 50, threshold: float = 0.3, names: Sequence[str] = NAMES, order: str = "ord") -> DataFrame:
    """The ``k`` rows of ``df`` most similar to each query string: query_id, query, rank, ``order``, match_rank.

    ``queries`` has query_id and query. A row's match_rank is the best trigram similarity of its names with the query, as in
    ``fuzzy_search``; rows below the threshold are left out, equal ones are taken in order. Different names are
    matched with different queries once (``similar_strings``). Then each matched name brings its first ``k`` rows only: a
    further one could not be among the best k. So a name that a large share of all rows has costs k rows. A null or
    empty query, or a name without letters and digits, matches nothing.
    """
    asked = queries.select("query_id", text("query").alias("query"))
    long = df.select(order, F.explode(F.array_distinct(F.array(*[text(c) for c in names]))).alias("value"))
    first = materialise(top_k_per_group(long, ["value"], [order], k).select("value", order, "rank"), "first-rows")
    found = similar_strings(asked.select(F.col("query").alias("value")), first.where("rank = 1").select("value", order), threshold, k, order)
    rows = found.join(first.drop("rank"), "value").groupBy("query", order).agg(F.max("similarity").alias("match_rank"))
    best = top_k_per_group(rows, ["query"], [F.col("match_rank").desc(), order], k)
    return best.join(asked, "query").select("query_id", "query", "rank", order, "match_rank")
