"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import NO_ID, Stored, arrow_rows, keyed_text
from tomeatlas.llm.words import ALPHANUMERIC, Words, windows, words_of

#: Words in a window that counts as contaminated, and words in a fingerprint.
SPAN, GRAM = 10, 5
#: Texts that go to a task's Python process at once.
ARROW_ROWS = 2000


def winnowed(w: Words, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of the fingerprints of all texts of a run.

    In each ``span - gram + 1`` consecutive grams the smallest hash is kept, the last one if there are several, so two
    texts that share ``span`` words share a fingerprint.
    """
    h, at = windows(w, gram)
    width = span - gram + 1
    n = len(h) - width + 1
    if n <= 0:
        return h[:0], at[:0]
    full = np.flatnonzero(w.doc[at[:n]] == w.doc[at[width - 1 :]])
    low, where = h[full], full.copy()
    for j in range(1, width):
        nxt = h[full + j]
        less = nxt <= low
        low[less], where[less] = nxt[less], full[less] + j
    where = np.unique(where)
    return h[where], at[where]


def fingerprints(texts: DataFrame, keys: list[str], column: str, span: int, gram: int, short: list[int], totals: bool) -> DataFrame:
    """Rows (keys, pos, size, print): winnowed grams of ``gram`` words, and all runs of each length in ``short``.

    A run of ``short`` words is a fingerprint of its own, with a window of one. With ``totals``, each text also gives a
    row of size 0, whose pos is its number of words.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch[k].to_numpy() for k in keys]
            for w in words_of(batch[column], ALPHANUMERIC):
                parts = [(gram, *winnowed(w, gram, span)), *((k, *windows(w, k)) for k in short)]
                rows = [(size, h, w.doc[at], w.pos[at]) for size, h, at in parts]
                if totals:
                    own = np.arange(w.first, w.first + len(w.count))
                    rows.append((0, own.astype(np.uint64), own, w.count))
                for size, h, doc, pos in rows:
                    if len(doc):
                        cols = [k[doc] for k in key] + [pos.astype(np.int64), np.full(len(doc), size, np.int32), h.view(np.int64)]
                        yield pa.record_batch([pa.array(c) for c in cols], names=[*keys, "pos", "size", "print"])

    return texts.select(*keys, column).mapInArrow(found, ", ".join(f"{k} long" for k in keys) + ", pos long, size int, print long")


def word_arrays(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out = []
    for w in words_of(pa.array(texts, pa.string()), ALPHANUMERIC):
        out += np.split(w.hash, np.cumsum(w.count)[:-1])
    return out


def _hit_words(words: np.ndarray, item: np.ndarray, shifts: list[int], span: int) -> list[tuple[int, int]]:
    """Stretches of ``words`` in which whole windows of the item occur, on the given diagonals (word minus item word)."""
    out = []
    for shift in shifts:
        lo, hi = max(0, shift), min(len(words), len(item) + shift)
        if hi - lo < span:
            continue
        same = np.concatenate([[False], words[lo:hi] == item[lo - shift : hi - shift], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        out += [(lo + int(a), lo + int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= span]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Words of each document that lie inside a window of a benchmark item, and the items found.

    Items with equal words are taken as one until the end. Fingerprints of documents and items are joined on their
    hash; Spark broadcasts the items' side while its size allows that and else shuffles both. A match names a diagonal
    of document and item, and is extended there in both directions over the words themselves; stretches of at least
    ``span`` words count. An item of fewer words counts where all of it occurs.

    A null or empty text has no words; nor has an item of none any window. Rows that repeat doc_id and text count once.
    Items may repeat: each of their ids is found. An item without id is not looked for. An empty benchmark leaves
    all documents clean; an empty table of documents gives no rows. Further columns are not read.

    Returns doc_id, n_words, n_hit, items (ids as strings, sorted), spans (array of first word and end), text_hash (xxhash64 of the
    text, which tells rows apart that have no doc_id or repeat one).
    """
    stored = Stored(docs.sparkSession, "winnowing")
    keys = ["doc", "row"]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    items = stored.save(items.where("words <> ''").distinct(), "items")
    kinds = items.groupBy("words").agg(F.min("item_id").alias("first"))
    kinds = stored.save(kinds.select(F.xxhash64("first").alias("kind"), "words", F.size(F.split("words", " ")).alias("n")), "kinds")
    short = sorted(r[0] for r in kinds.where(F.col("n") < span).select("n").distinct().collect())  # fewer than ``span`` numbers
    prints = fingerprints(kinds.where(F.col("n") >= span), ["kind"], "words", span, gram, [], False)
    for k in short:
        prints = prints.unionByName(fingerprints(kinds.where(F.col("n") == k), ["kind"], "words", span, gram, [k], False))
    prints = stored.save(prints.withColumnRenamed("pos", "item_pos"), "prints")

    texts = keyed_text(docs)
    own = fingerprints(texts, keys, "text", span, gram, short, True)
    met = own.join(prints, ["print", "size"], "left").where((F.col("size") == 0) | F.col("kind").isNotNull())
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        seeds = stored.save(met.select(*keys, "kind", "pos", (F.col("pos") - F.col("item_pos")).alias("shift")), "seeds")
    diagonals = seeds.where("kind is not null").groupBy(*keys, "kind").agg(F.collect_set("shift").alias("shifts"))
    by_row = diagonals.join(kinds.select("kind", "words"), "kind").groupBy(*keys).agg(F.collect_list(F.struct("kind", "words", "shifts")).alias("seeds"))
    by_row = stored.save(by_row, "diagonals")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                found = batch["seeds"][i].as_py()
                own = word_arrays([batch["text"][i].as_py()])[0]
                hits = [(s["kind"], _hit_words(own, item, s["shifts"], min(span, len(item)))) for s, item in zip(found, word_arrays([s["words"] for s in found]))]
                if kinds := [kind for kind, at in hits if at]:
                    spans = _merged([x for _, at in hits for x in at])
                    out.append({"doc": batch["doc"][i].as_py(), "row": batch["row"][i].as_py(), "kinds": kinds, "spans": [{"first": a, "end": b} for a, b in spans]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("kinds", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]))

    hits = texts.join(by_row, keys).mapInArrow(extended, "doc long, row long, kinds array<bigint>, spans array<struct<first: bigint, end: bigint>>")
    hits = stored.save(hits, "hits")
    ids = items.join(kinds.select("kind", "words"), "words").select("kind", "item_id")
    found = hits.select(*keys, F.explode("kinds").alias("kind")).distinct().join(ids, "kind").groupBy(*keys).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    spans = hits.groupBy(*keys).agg(F.first("spans").alias("spans"))
    counts = seeds.where("kind is null").groupBy(*keys).agg(F.max("pos").alias("n_words"))
    out = counts.join(spans, keys, "left").join(found, keys, "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first: bigint, end: bigint>>")).alias("spans"), F.col("row").alias("text_hash"),
    )
