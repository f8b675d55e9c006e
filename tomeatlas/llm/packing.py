"""Best-fit packing of token sequences, in a tree of rounds over what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import Stored, arrow_rows, with_empty_text
from tomeatlas.llm.tokens import word_ranks, word_tokenizer

#: A bin with at most this many free places is nearly full and leaves the tree.
NEARLY_FULL = 0
#: Items that one task packs together; later rounds use as many tasks as keep to it.
GROUP = 100_000
#: Groups of one round that meet in one group of the next.
FAN_IN = 8
#: Texts that go to a task's Python process at once.
ARROW_ROWS = 2000

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_PIECE_SQL = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
_BIN = pa.schema([("size", pa.int64()), ("pieces", pa.list_(_PIECE))])


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items to bins, largest first, each into the fullest bin that takes it; open bins are kept by free places."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes = 0  # bit f is set if a bin with f free places is open
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free_sizes >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_sizes &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            open_bins[left].append(b)
            free_sizes |= 1 << left
    return bins


def _packed(items: list[list[dict]], capacity: int) -> pa.RecordBatch:
    """Bins of items; an item is the list of its pieces, which keep their order and move to its place."""
    sizes = np.array([sum(p["length"] for p in item) for item in items], np.int64)
    out_sizes, out_pieces = [], []
    for members in best_fit(sizes, capacity):
        at, pieces = 0, []
        for i in members:
            pieces += [{**p, "offset": p["offset"] + at} for p in items[i]]
            at += int(sizes[i])
        out_sizes.append(at)
        out_pieces.append(pieces)
    return pa.record_batch([pa.array(out_sizes, pa.int64()), pa.array(out_pieces, pa.list_(_PIECE))], schema=_BIN)


def _in_chunks(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP, nearly_full: int = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """Pack token sequences of documents into as few sequences of at most ``capacity`` tokens as best-fit rounds can.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of that length and a
    shorter last one. Each task packs the pieces of its documents, ``group`` at a time, best-fit with the largest
    first. Bins with at most ``nearly_full`` free places are done; the others become items of the next round, in
    which ``fan_in`` groups meet, and so on up to a single group. A round never has groups of more than about
    ``group`` items: if bins will not combine, the tree ends as soon as a round saves nothing. Texts are read once and
    never shuffled; an item carries its pieces (at most ``capacity``).

    Null and empty texts are sequences of just ``end_id``. Repeated rows are packed each. An empty table gives no
    rows. Further columns are not read.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    stored = Stored(spark, "packing")
    end = end_id.to_bytes(4, "little")
    cut = capacity * 4
    ranks = spark.sparkContext.broadcast(word_ranks(tokenizer_path))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_path, ranks)
        items: list[list[dict]] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = tokens.encode(text.as_py()) + end
                for k in range(0, len(ids), cut):
                    part = ids[k : k + cut]
                    items.append([{"doc_id": doc_id, "piece": k // cut, "start": k // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "offset": 0}])
            while len(items) >= group:
                yield from _in_chunks(_packed(items[:group], capacity))
                items = items[group:]
        yield from _in_chunks(_packed(items, capacity))

    def next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[list[dict]] = []
        for batch in batches:
            items += batch["pieces"].to_pylist()
            while len(items) >= group:
                yield from _in_chunks(_packed(items[:group], capacity))
                items = items[group:]
        yield from _in_chunks(_packed(items, capacity))

    schema = f"size bigint, pieces array<{_PIECE_SQL}>"
    with arrow_rows(spark, ARROW_ROWS):
        bins = stored.save(with_empty_text(docs).mapInArrow(first_round, schema), "round")
    under = F.col("size") < capacity - nearly_full
    groups = bins.rdd.getNumPartitions()
    done = [bins.where(~under)]
    open_bins = bins.where(under)
    n = open_bins.count()
    level = 0
    while n > 1:
        groups = max(-(-groups // fan_in), -(-n // group))
        level += 1
        dealt = open_bins.repartition(groups, F.xxhash64(F.lit(level), "size", F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["piece"]))
        bins = stored.save(dealt.mapInArrow(next_round, schema), "round")
        done.append(bins.where(~under))
        open_bins = bins.where(under)
        was, n = n, open_bins.count()
        if groups == 1 or bins.count() == was:
            break
    done.append(open_bins)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    # any numbers serve: one for each bin of the written tables
    numbered = stored.save(out.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces"), "sequences")
    for df, _ in list(stored.paths.values()):
        if df is not numbered:
            stored.drop(df)
    return numbered.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
