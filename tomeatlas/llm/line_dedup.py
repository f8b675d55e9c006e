"""Lines that repeat across documents, exactly or but for one or two edits, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import NO_ID, Stored, few, keyed_text
from tomeatlas.llm.words import mixed

#: Characters from which on a line may differ by one edit, and by two, and still count as repeated; shorter ones must be equal.
LEAST_CHARS = (8, 40)
#: Characters taken at once; a longer line is taken alone.
PIECE = 1 << 20
#: Rows (places of lines, at most 200 bytes each in memory) that a join broadcasts at most, and bytes of lines. Spark goes by
#: the size of compressed files, and takes the variants of lines for as small as the lines.
FEW, FEW_BYTES = 250_000, 1 << 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, in steps of a megabyte at least."""
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
    return up, down


class _Lines:
    """Hashes of any stretch of the lines of one run."""

    def __init__(self, lines: list[str]):
        self.code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.length = np.array([len(x) for x in lines], np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.up, down = _powers(-(-max(len(self.code), 1) // PIECE) * PIECE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.code + np.uint64(1)) * down[: len(self.code)], dtype=np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial hash of the characters from ``a`` to ``b``, the same wherever they stand."""
        return np.where(b > a, (self.sums[b] - self.sums[a]) * self.up[np.maximum(b - 1, 0)], np.uint64(0))

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, place and hash of each line without the character at that place."""
        at = np.arange(len(self.code))
        line = np.repeat(np.arange(len(self.length)), self.length)
        s, e = self.start[line], self.end[line]
        rest = (self.sums[at] - self.sums[s]) * self.up[np.maximum(e - 2, 0)] + (self.sums[e] - self.sums[at + 1]) * self.up[np.maximum(e - 1, 0)]
        return line, at - s, np.where(e - s > 1, rest, np.uint64(0))

    def pieces(self, edits: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of pieces of each line, and which of them count; two lines within the bound have one in common.

        Of two lines ``e`` edits apart, one of ``e + 1`` pieces of the shorter is whole in the other: the first at its
        place, the last at its distance from the end, one between them at most ``e - 1`` characters off.
        """
        s, e, n = self.start, self.end, self.length
        keys, counts = [], []
        for bound in range(1, edits + 1):
            for less in range(bound + 1):  # the other line is shorter by so much
                m = np.maximum(n - less, 0)
                cuts = [m * i // (bound + 1) for i in range(bound + 2)]
                for i in range(bound + 1):
                    tag = mixed(m.astype(np.uint64) * np.uint64(16) + np.uint64(4 * bound + i))
                    for off in [0] if i == 0 else [less] if i == bound else range(1 - bound, bound):
                        h = self.hash(np.clip(s + cuts[i] + off, s, e), np.clip(s + cuts[i + 1] + off, s, e))
                        keys.append(mixed(h + tag))
                        counts.append(n >= least[bound - 1])
        return np.stack(keys, axis=1), np.stack(counts, axis=1)

    def without_two(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of line ``k`` without the characters at ``i`` and at any later place."""
        s, e, n = self.start[k], self.end[k], self.length[k]
        later = n - 1 - i
        one = np.repeat(i, later)
        two = np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later) + one + 1
        sums, up = self.sums, self.up
        rest = (sums[s + one] - sums[s]) * up[max(e - 3, 0)] + (sums[s + two] - sums[s + one + 1]) * up[max(e - 2, 0)] + (sums[e] - sums[s + two + 1]) * up[e - 1]
        return one, two, rest if n > 2 else np.zeros_like(rest)


def _runs(lines: list[str]) -> Iterator[tuple[int, _Lines]]:
    first = 0
    while first < len(lines):
        last, chars = first, 0
        while last < len(lines) and (last == first or chars + len(lines[last]) <= PIECE):
            chars += len(lines[last])
            last += 1
        yield first, _Lines(lines[first:last])
        first = last


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _place():
    return F.struct("doc", "line", "row")


def _within_one(stored: Stored, bodies: DataFrame) -> DataFrame:
    """Pairs (at, first) of lines one edit apart, among them each line and the earliest one.

    Lines with the same variant at the same place differ in that character; a line equal to another one's variant lacks it.
    """

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in _runs(batch["chars"].to_pylist()):
                line, at, h = run.variants()
                own = np.arange(len(run.length))
                rows = pa.array(np.concatenate([own, line]) + first)
                yield pa.record_batch({**{c: batch[c].take(rows) for c in ("doc", "row", "line")}, "place": pa.array(np.concatenate([np.full(len(own), -1), at]).astype(np.int32)), "variant": _signed(np.concatenate([run.hash(run.start, run.end), h]))})

    variants = bodies.mapInArrow(deleted, "doc long, row long, line int, place int, variant long").select("variant", "place", _place().alias("at"))
    # the earliest line of each key and place; its own line has place -1 and meets all places of its variant
    firsts = variants.groupBy("variant", "place").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    firsts = stored.save(firsts, "variants")
    several = firsts.where("first <> last").select("variant", "place", "first")
    same_place = variants.join(few(several, FEW), ["variant", "place"]).where("at <> first").select("at", "first")
    whole = firsts.where("place = -1").select("variant", F.col("first").alias("whole"))
    cut = variants.where("place >= 0").join(few(whole, FEW), "variant").where("at <> whole")
    lacking = cut.select(F.greatest("at", "whole").alias("at"), F.least("at", "whole").alias("first"))
    return same_place.unionByName(lacking)


#: Keys that a task sends on at once.
KEYS = 1 << 18


def _within_two(stored: Stored, bodies: DataFrame) -> DataFrame:
    """Pairs (at, first) of lines at most two edits apart, among them each line and the earliest one.

    A deletion's gap is its place in what is left. Two lines with one variant are as far apart as the gaps of both need
    together. So within two are: lines that lose two characters at the same two gaps (kind 1); one that loses two and one
    that loses one at either gap (kind 2); lines that lose one or none (kind 3); one that loses two and one that loses none
    (kind 4). Kinds 2 and 4 have two sides, whose lines meet the earliest one of the other side.
    """

    def keys(run: _Lines, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        s, e, n = run.start[k], run.end[k], int(run.length[k])
        zero = np.zeros(1, np.int64)
        whole = run.hash(run.start[k : k + 1], run.end[k : k + 1])
        at = np.arange(n)
        lost = (run.sums[s + at] - run.sums[s]) * run.up[max(e - 2, 0)] + (run.sums[e] - run.sums[s + at + 1]) * run.up[e - 1]
        lost = lost if n > 1 else np.zeros_like(lost)
        yield from ((3, whole, zero, 0), (4, whole, zero, 1), (2, lost, at, 1), (3, lost, np.zeros_like(at), 0))
        step = max(KEYS // n, 1)
        for first in range(0, n, step):
            one, two, left = run.without_two(k, np.arange(first, min(first + step, n)))
            yield from ((1, left, (one << 28) + two - 1, 0), (2, left, one, 2), (2, left, two - 1, 2), (4, left, np.zeros_like(one), 2))

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in _runs(batch["chars"].to_pylist()):
                for k in range(len(run.length)):
                    for kind, variant, gaps, side in keys(run, k):
                        rows = pa.array(np.full(len(gaps), first + k))
                        own = {c: batch[c].take(rows) for c in ("doc", "row", "line")}
                        yield pa.record_batch({**own, "variant": _signed(variant), "gaps": pa.array((kind << 56) + gaps), "side": pa.array(np.full(len(gaps), side, np.int8))})

    rows = bodies.mapInArrow(emitted, "doc long, row long, line int, variant long, gaps long, side byte").select("variant", "gaps", "side", _place().alias("at"))
    firsts = rows.groupBy("variant", "gaps").agg(*[F.min(F.when(F.col("side") == i, F.col("at"))).alias(f"s{i}") for i in range(3)], F.max("at").alias("last"))
    firsts = stored.save(firsts.where("s0 <> last or (s1 is not null and s2 is not null)"), "variants-two")
    other = F.when(F.col("side") == 0, F.col("s0")).when(F.col("side") == 1, F.col("s2")).otherwise(F.col("s1"))
    met = rows.join(few(firsts, FEW), ["variant", "gaps"]).select("at", other.alias("other")).where("at <> other")
    return met.select(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("first"))


def repeated_lines(docs: DataFrame, edits: int = 1, least: tuple[int, ...] = LEAST_CHARS) -> DataFrame:
    """Lines that an earlier line within the edit bound makes redundant, with the earliest such line.

    Earlier is by doc_id (null first), then line number. Equal lines are one, at their earliest place. Two lines may be
    ``edits`` (1 or 2) edits apart, if the shorter has ``least[0]`` characters for one edit, ``least[1]`` for two. Then they
    share a piece (see ``_Lines.pieces``), and lines that share none are left out. Each of the others emits the hash of
    itself and of every variant with up to ``edits`` characters deleted. The keys are such that all lines of a key, or of
    both its sides, are within the bound; so each meets the earliest line of its key only, and a key with many lines makes
    no pairs. Each pair's edit distance is verified.

    Variants grow with a line's length for one edit, with its square for two; they are made in blocks of bounded size.

    Lines end at a line feed. Lines without any character but blanks stay. A null text has no line. Rows that repeat
    doc_id and text are one document. Further columns are not read.

    Returns doc, row (see ``keyed_text``), line (from 0), first_doc, first_row, first_line.
    """
    if edits not in (1, 2) or len(least) < edits:
        raise ValueError("edits is 1 or 2, with a least length for each")
    stored = Stored(docs.sparkSession, "lines")
    texts = keyed_text(docs)
    spread = texts.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("line", "chars"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in _runs(batch["chars"].to_pylist()):
                keys, counts = run.pieces(edits, least)
                offsets = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int32)
                flat, n = keys[counts], len(run.length)
                yield pa.record_batch({**{c: batch[c].slice(first, n) for c in ("doc", "row", "line", "h1", "h2")}, "keys": pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))})

    solid = spread.where(F.trim(F.translate("chars", "\t\x0b\x0c\r", "    ")) != "")
    hashed = solid.select("doc", "row", "line", "chars", F.xxhash64("chars").alias("h1"), F.xxhash64(F.lit(1), F.char_length("chars"), "chars").alias("h2"))
    all_lines = stored.save(hashed.mapInArrow(keyed, "doc long, row long, line int, h1 long, h2 long, keys array<bigint>"), "lines")
    place = _place()
    distinct = stored.save(all_lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "distinct")
    keys = distinct.select("at", F.explode("keys").alias("key")).distinct()
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    near = keys.join(often.hint("merge"), "key", "left_semi").select("at").distinct()
    wanted = stored.save(near.groupBy("at.doc", "at.row").agg(F.collect_list("at.line").alias("lines")), "wanted")
    asked = wanted.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    bodies = texts.join(F.broadcast(wanted) if asked <= FEW else wanted.hint("merge"), ["doc", "row"]).select("doc", "row", "lines", F.split("text", "\n").alias("all"))
    bodies = bodies.select("doc", "row", F.explode("lines").alias("line"), "all").select("doc", "row", "line", F.get("all", "line").alias("chars")).dropDuplicates(["doc", "row", "line"])
    bodies = stored.save(bodies, "bodies")

    pairs = _within_one(stored, bodies)
    if edits == 2:
        pairs = pairs.unionByName(_within_two(stored, bodies.where(F.char_length("chars") >= least[1])))
    pairs = pairs.distinct()
    if bodies.agg(F.coalesce(F.sum(F.octet_length("chars")), F.lit(0))).first()[0] > FEW_BYTES or asked > FEW:
        bodies = bodies.hint("merge")
    one = bodies.select(place.alias("at"), F.col("chars").alias("x"))
    two = bodies.select(place.alias("first"), F.col("chars").alias("y"))
    bound = F.lit(1) if edits == 1 else F.when(F.least(F.char_length("x"), F.char_length("y")) >= least[1], 2).otherwise(1)
    apart = F.levenshtein("x", "y", edits)
    close = pairs.join(one, "at").join(two, "first").where((apart >= 0) & (apart <= bound))
    nearest = stored.save(close.groupBy("at").agg(F.min("first").alias("near")), "close")
    judged = distinct.join(few(nearest, FEW), "at", "left").where("n > 1 or near is not null").select("h1", "h2", "at", "near")
    judged = stored.save(judged, "judged")
    lines = all_lines.select("h1", "h2", "doc", "row", "line").join(few(judged, FEW), ["h1", "h2"])
    first = F.when(F.col("at") == place, F.col("near")).otherwise(F.coalesce(F.least("at", "near"), "at"))
    out = lines.select("doc", "row", "line", first.alias("f")).where("f is not null").distinct()
    out = stored.save(out.select("doc", "row", "line", F.col("f.doc").alias("first_doc"), F.col("f.row").alias("first_row"), F.col("f.line").alias("first_line")), "repeated")
    for df, _ in list(stored.paths.values()):
        if df is not out:
            stored.drop(df)
    return out


def without_repeated_lines(docs: DataFrame, edits: int = 1, least: tuple[int, ...] = LEAST_CHARS) -> DataFrame:
    """Each document with its text less repeated lines: doc_id, n_lines, n_kept, text. See ``repeated_lines``.

    A null text stays null, with no lines. An empty table gives no rows.
    """
    repeated = repeated_lines(docs, edits, least)
    dropped = repeated.groupBy("doc", "row").agg(F.collect_set("line").alias("dropped"))
    rows, texts = repeated.agg(F.count(F.lit(1)), F.count_distinct("doc", "row")).first()
    dropped = dropped if rows <= 8 * FEW and texts <= FEW else dropped.hint("merge")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    lines = own.join(dropped, ["doc", "row"], "left").select("doc", "text", F.split("text", "\n").alias("all"), F.map_from_entries(F.transform(F.coalesce("dropped", F.array().cast("array<int>")), lambda i: F.struct(i, F.lit(True)))).alias("dropped"))
    kept = lines.withColumn("kept", F.filter("all", lambda x, i: F.col("dropped")[i].isNull()))
    return kept.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_kept"), F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
    )
