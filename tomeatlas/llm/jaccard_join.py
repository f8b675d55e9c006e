"""Similarity join of documents on the Jaccard index of their word shingles, by rare-first prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.components import components
from tomeatlas.llm.stored import Stored, arrow_rows, with_empty_text
from tomeatlas.llm.words import NOT_BLANK, Words, mixed, windows, words_of

SHINGLE, THRESHOLD = 5, 75
#: Rounds in which each shingle's documents meet one of them only.
STAR_ROUNDS = 2
#: Bytes of text for each part into which shingles are dealt.
PART_BYTES = 8 << 20
#: Shingles that a task deals out at once.
SENT_SHINGLES = 1 << 17
#: Texts, and bytes of texts or blocks, that come to a task's Python process at once.
ARROW_ROWS, ARROW_BYTES = 500, 2 << 20
#: Ranges of shingles in which documents are counted for the suffix filter.
RANGES = 16
_LOW = np.uint64((1 << 48) - 1)
#: Kinds of blocks: ids, sizes and classes of texts; shingles; sizes of classes.
TEXTS, SHINGLES, SIZES = 0, 1, 2


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of a run; a text of fewer than ``k`` words has one of all its words."""
    first = np.cumsum(w.count) - w.count
    parts = [windows(w, k), *(windows(w, n, first[w.count == n]) for n in range(1, k))]
    h, at = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    return h[order], w.doc[at[order]]


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run: first text, size and class of each text's set, and the distinct shingles by hash with their text.

    Equal sets have equal classes: sums of their mixed hashes.
    """
    for w in words_of(texts, NOT_BLANK):
        h, doc = _shingles(w, k)
        n = len(w.count)
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order] - w.first
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        once = np.zeros(len(h), bool)
        once[order[new]] = True
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(once, mixed(h), np.uint64(0)), dtype=np.uint64)])
        edge = np.searchsorted(doc - w.first, np.arange(n + 1))
        yield w.first, np.bincount(ds[new], minlength=n), sums[edge[1:]] - sums[edge[:-1]], hs[new], ds[new]


def _dealt(ids: np.ndarray, sizes, classes, hashes, owners, parts: int) -> Iterator[dict]:
    """Rows for the shuffle: the texts' ids, sizes and classes, and each part's shingles, six bytes and an owner each."""
    some = np.flatnonzero(sizes)
    if len(some):
        yield {"part": int(mixed(ids[some[:1]].astype(np.uint64))[0] % np.uint64(parts)), "kind": TEXTS, "x": ids[some].astype(np.int64).tobytes(), "y": sizes[some].astype(np.int64).tobytes(), "z": classes[some].tobytes()}
    firsts = np.zeros(len(sizes), bool)  # of copies the first one speaks for all
    firsts[some[np.unique(classes[some], return_index=True)[1]]] = True
    keep = firsts[owners]
    hashes, owners = hashes[keep], owners[keep]
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(edge)):
        h, o = hashes[edge[p] : edge[p + 1]], owners[edge[p] : edge[p + 1]]
        members, local = np.unique(o, return_inverse=True)
        planes = np.ascontiguousarray((h & _LOW).view(np.uint8).reshape(-1, 8)[:, :6].T)
        yield {"part": int(p), "kind": SHINGLES, "x": planes.tobytes(), "y": local.astype(np.uint16).tobytes(), "z": classes[members].tobytes()}


def _dealt_batches(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts of one task, dealt out whenever enough shingles are held."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        held: list[tuple] = []

        def sent():
            sizes, classes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            h, o = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            order = np.argsort(h, kind="stable")
            first = held[0][4]
            return pa.RecordBatch.from_pylist(list(_dealt(ids[first : first + len(sizes)], sizes, classes, h[order], o[order], parts)), _BLOCK)

        for first, size, cls, h, o in _sets(batch["text"], k):
            before = sum(len(x[0]) for x in held)
            if held and (before + len(size) > 65_000 or sum(len(x[2]) for x in held) > SENT_SHINGLES):
                yield sent()
                held, before = [], 0
            held.append((size, cls, h, o + before, first))
        if held:
            yield sent()


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """All arrays of a list as one; the list gives them up, so that a task holds its values once."""
    whole = np.concatenate(arrays)
    arrays.clear()
    return whole


def _shared(part: int, hashes: list[np.ndarray], classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, token and frequency of shingles that more than one class has; the lists are emptied."""
    h, c = _joined(hashes), _joined(classes)
    order = np.argsort(h)
    h = h[order]
    c = c[order]
    del order
    same = h[1:] == h[:-1]
    more = np.zeros(len(h), bool)
    more[1:] |= same
    more[:-1] |= same
    h, c = h[more], c[more]
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[new], c[new]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(h)))
    freq = np.repeat(size, size)
    keep = freq > 1
    return c[keep], h[keep] + (np.uint64(part) << np.uint64(48)), freq[keep]


_BLOCK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_BLOCK_SQL = "part int, kind int, x binary, y binary, z binary"
_PREFIX = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64())]))
_SET_SQL = "class long, doc_id long, n long, alone long, tokens array<bigint>, prefix array<struct<token: bigint, pos: bigint>>, ranges array<smallint>"


def _blocks(kind: int, by: np.ndarray, classes: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, dealt into parts by ``by``."""
    part = (by % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    classes, x, y = classes[order], x[order], y[order]
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [{"part": int(p), "kind": kind, "x": classes[cut].tobytes(), "y": x[cut].tobytes(), "z": y[cut].tobytes()} for p in np.flatnonzero(np.diff(edge)) for cut in [slice(edge[p], edge[p + 1])]]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _BLOCK)


def _sets_of(classes, tokens, freqs, known: np.ndarray, sizes: np.ndarray, threshold: int) -> pa.RecordBatch:
    """Sets that can link at all: shared shingles, prefix of these in rare-first order, counts by range of shingle.

    ``known`` are the classes with their ``sizes``. All other shingles of a set come before the shared ones, as no other
    set has them.
    """
    order = np.lexsort((tokens, freqs, classes))
    c, t = classes[order], tokens[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    shared = np.diff(np.append(edge, len(c)))
    n = sizes[np.searchsorted(known, c[edge])]
    able = shared * 100 >= n * threshold
    t = t[np.repeat(able, shared)]
    cls, n, shared = c[edge][able], n[able], shared[able]
    alone = n - shared
    start = np.cumsum(shared) - shared
    length = n - -(-threshold * n // 100) + 1 - alone
    owner = np.repeat(np.arange(len(cls)), length)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    prefix = pa.StructArray.from_arrays([pa.array(t[start[owner] + nth].view(np.int64)), pa.array(alone[owner] + nth)], ["token", "pos"])
    key = np.repeat(np.arange(len(cls)), shared) * RANGES + (mixed(t) >> np.uint64(60)).astype(np.int64)
    ranges = np.minimum(np.bincount(key, minlength=len(cls) * RANGES), 32_767).astype(np.int16)
    upto = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.record_batch({
        "class": pa.array(cls.view(np.int64)), "doc_id": pa.nulls(len(cls), pa.int64()), "n": pa.array(n), "alone": pa.array(alone),
        "tokens": pa.ListArray.from_arrays(upto(shared), pa.array(t.view(np.int64))), "prefix": pa.ListArray.from_arrays(upto(length), prefix).cast(_PREFIX),
        "ranges": pa.ListArray.from_arrays(upto(np.full(len(cls), RANGES)), pa.array(ranges)),
    })


def shingle_sets(docs: DataFrame, k: int, threshold: int, stored: Stored) -> DataFrame:
    """Rows of two kinds: (class, doc_id, n) for texts with words, and the sets of ``_sets_of`` without a doc_id.

    Texts are read once. Shingles travel in blocks twice: a block for each run of texts and part of the shingles, at
    eight bytes a shingle, to find those that several sets have; and these on to the part of their class. The
    numbers of parts grow with the text. A shingle's frequency counts different sets.
    """
    spark = docs.sparkSession
    plain = with_empty_text(docs)
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, class_parts = max(few, total // PART_BYTES + 1), max(few, total // (8 * PART_BYTES) + 1)

    def met(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = [], []
        for b in blocks:
            for kind, x, y, z in zip(*(b[c].to_pylist() for c in ("kind", "x", "y", "z"))):
                own = np.frombuffer(z, np.uint64)
                if kind == TEXTS:
                    ids, n = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                    yield from _blocks(TEXTS, mixed(ids.view(np.uint64)), own, ids, n, class_parts)
                    once, at = np.unique(own, return_index=True)
                    yield from _blocks(SIZES, once, once, n[at], n[at], class_parts)
                    continue
                planes = np.frombuffer(x, np.uint8).reshape(6, -1)
                h = np.zeros((planes.shape[1], 8), np.uint8)
                h[:, :6] = planes.T
                hashes.append(h.view(np.uint64).ravel())
                classes.append(own[np.frombuffer(y, np.uint16)])
        if hashes:
            cls, token, freq = _shared(key[0].as_py(), hashes, classes)
            yield from _blocks(SHINGLES, cls, cls, token, freq.astype(np.uint32), class_parts)

    def gathered(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, shared = [], ([], [], [])
        for b in blocks:
            for kind, x, y, z in zip(*(b[c].to_pylist() for c in ("kind", "x", "y", "z"))):
                cls = np.frombuffer(x, np.uint64)
                if kind == TEXTS:
                    none = {"alone": pa.nulls(len(cls), pa.int64()), "tokens": pa.nulls(len(cls), pa.list_(pa.int64())), "prefix": pa.nulls(len(cls), _PREFIX), "ranges": pa.nulls(len(cls), pa.list_(pa.int16()))}
                    yield pa.record_batch({"class": pa.array(cls.view(np.int64)), "doc_id": pa.array(np.frombuffer(y, np.int64)), "n": pa.array(np.frombuffer(z, np.int64)), **none})
                elif kind == SIZES:
                    sizes.append((cls, np.frombuffer(y, np.int64)))
                else:
                    for held, a in zip(shared, (cls, np.frombuffer(y, np.uint64), np.frombuffer(z, np.uint32))):
                        held.append(a)
        if shared[0]:
            cls, n = (np.concatenate(x) for x in zip(*sizes))
            known, at = np.unique(cls, return_index=True)
            yield _sets_of(*map(_joined, shared), known, n[at], threshold)

    blocks = plain.where("doc_id is not null").mapInArrow(lambda batches: _dealt_batches(batches, k, parts), _BLOCK_SQL)
    found = blocks.groupBy("part").applyInArrow(met, _BLOCK_SQL).groupBy("part").applyInArrow(gathered, _SET_SQL)
    with arrow_rows(spark, ARROW_ROWS, ARROW_BYTES):
        return stored.save(found, "sets")


def _may_link(a: str, b: str, threshold: int) -> Column:
    """Length, positional and suffix filter; true for the first shared prefix shingle of any two sets that link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil((n + m) * threshold / F.lit(100.0 + threshold) - 1e-9)
    length = F.least(n, m) * 100 >= F.greatest(n, m) * threshold
    position = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) >= need
    apart = F.aggregate(F.zip_with(f"{a}.ranges", f"{b}.ranges", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    suffix = F.col(f"{a}.alone") + F.col(f"{b}.alone") + apart <= n + m - need * 2
    return length & position & suffix


def _across(labelled: DataFrame, threshold: int) -> DataFrame:
    """Pairs of classes that share a prefix shingle, are not connected yet and pass the filters.

    One of two unconnected classes lies outside the shingle's largest group of connected ones, so only those outside
    meet the others. The smaller of a pair meets on the start of its prefix alone: sets that are not smaller need
    more of it. The filters are conditions of the joins, which give only pairs that pass.
    """
    sizes = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("n", "label")).alias("m")).select("token", F.col("m.label").alias("largest"))
    outside = labelled.join(largest, "token").where("label <> largest").select("token", F.col("label").alias("label1"), F.col("e").alias("x"))
    anyone = labelled.select("token", F.col("label").alias("label2"), F.col("e").alias("y"))

    def early(e: str) -> Column:
        n = F.col(f"{e}.n")
        return F.col(f"{e}.pos") <= n - F.ceil(n * (2 * threshold) / F.lit(100.0 + threshold) - 1e-9)

    def size(e: str) -> Column:
        return F.struct(F.col(f"{e}.n"), F.col(f"{e}.class"))

    out = []
    for one, two, order in ((outside.where(early("x")), anyone, size("x") < size("y")), (outside, anyone.where(early("y")), size("y") < size("x"))):
        one, two = one.alias("one"), two.alias("two")
        out.append(one.join(two, (F.col("one.token") == F.col("two.token")) & (F.col("label1") != F.col("label2")) & order & _may_link("x", "y", threshold)))
    first, second = (df.select("x.class", F.col("y.class").alias("other")) for df in out)
    return first.unionByName(second)


def similar_documents(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """Components of documents linked by a Jaccard index of at least ``threshold`` percent of their word shingles.

    Equal sets are one class. A class goes on only if enough of its shingles occur elsewhere to link at all. Shingles are
    ordered rare first; classes meet on the shingles of their prefixes, pass the length, positional and suffix filter,
    and each pair is verified once on whole sets. First each shingle's classes meet only one of them, in a few rounds;
    classes found connected need not meet again. Then all classes that share a prefix shingle but are not connected yet
    meet, so no link between components is lost, and a group of near copies does not make all its pairs.

    Null and empty texts have no shingles and link with nothing, nor do rows without doc_id. Rows that repeat a doc_id are
    joined as its component. An empty table gives no rows. Further columns are not read.

    Links are neither listed nor counted: pairs that are already connected are never verified.

    Returns doc_id, n_shingles, component_id for every row.
    """
    stored = Stored(docs.sparkSession, "jaccard")
    found = shingle_sets(docs, k, threshold, stored)
    texts = found.where("doc_id is not null").select("doc_id", "class", "n")
    sets = found.where("doc_id is null")
    entries = sets.select(F.explode("prefix").alias("p"), "class", "n", "alone", "ranges").select(F.col("p.token").alias("token"), "class", F.struct("alone", "class", "n", F.col("p.pos").alias("pos"), "ranges").alias("e"))
    labels = stored.save(sets.select("class", F.col("class").alias("label")), "labels")
    verified, held = None, []
    bodies = sets.select("class", "n", "tokens")
    for r in range(star_rounds + 1):
        labelled = entries.join(labels, "class").select("token", "class", "e", "label")
        open_tokens = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        labelled = stored.save(labelled.join(open_tokens, "token"), "entries")
        for df in held:
            stored.drop(df)
        entries, held = labelled.drop("label"), [labelled]  # a shingle whose classes are connected is done with
        if r < star_rounds:
            choice = F.struct(F.xxhash64(F.lit(r), "label").alias("by"), "e", "label") if r else F.struct(F.lit(0).alias("by"), "e", "label")
            centre = labelled.groupBy("token").agg(F.min(choice).alias("c")).select("token", F.col("c.e").alias("y"), F.col("c.label").alias("c_label"))
            met = labelled.select("token", "label", F.col("e").alias("x")).join(centre, "token")
            pairs = met.where((F.col("label") != F.col("c_label")) & _may_link("x", "y", threshold)).select("x.class", F.col("y.class").alias("other"))
        else:
            pairs = _across(labelled, threshold)
        pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        mine = bodies.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        theirs = bodies.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        met = pairs.join(mine, "a").join(theirs, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
        links = stored.save(met.select("a", "b", (F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * threshold).alias("linked")), "links")
        verified = links.select("a", "b") if verified is None else verified.unionByName(links.select("a", "b"))
        linked = links.where("linked")
        if linked.isEmpty():
            continue
        ends = labels.select(F.col("class").alias("a"), F.col("label").alias("la")), labels.select(F.col("class").alias("b"), F.col("label").alias("lb"))
        joined = components(linked.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), stored)
        moved = labels.join(joined.select(F.col("node").alias("label"), "to"), "label", "left").select("class", F.coalesce("to", "label").alias("label"))
        moved = stored.save(moved, "labels")
        stored.drop(labels)
        labels = moved
    grouped = stored.save(texts.join(labels, "class", "left").select("doc_id", "n", F.coalesce("label", "class").alias("label")), "grouped")
    for df in (found, labels, *held):
        stored.drop(df)
    lowest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    per_doc = grouped.join(lowest, "label").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
