"""Draw of the documents that look most like a target collection, by hashed n-gram weights and a distributed quickselect."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import Stored
from tomeatlas.llm.words import ALPHANUMERIC, Words, words_of

#: Buckets of the feature counts.
BUCKETS = 10_000
#: Pivot keys of one round; a round leaves about one part in so many of the rows.
PIVOTS = 15
#: Longer words are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def _fed(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _fed_words(state: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """States of crc32 after the bytes of the words ``at``."""
    state, start, size = state.copy(), w.start[at], (w.end - w.start)[at]
    for i in np.flatnonzero(size > LONG):
        state[i] = zlib.crc32(w.data[start[i] : start[i] + size[i]].tobytes(), int(~state[i])) ^ 0xFFFFFFFF
    todo = np.flatnonzero(size <= LONG)
    for step in range(LONG):
        todo = todo[size[todo] > step]
        if not len(todo):
            break
        state[todo] = _fed(state[todo], w.data[start[todo] + step])
    return state


def _features(w: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the text in the run, and bucket, of every run of 1, 2, ... ``longest`` words joined by one space."""
    doc = w.doc - w.first
    at = np.arange(len(doc))
    state = _fed_words(np.full(len(doc), 0xFFFFFFFF, np.uint32), w, at)
    for n in range(1, longest + 1):
        yield doc[at], (~state % np.uint32(buckets)).astype(np.int64)
        whole = np.flatnonzero(at + n < len(doc))
        whole = whole[doc[at[whole]] == doc[at[whole] + n]]
        at = at[whole]
        state = _fed_words(_fed(state[whole], np.full(len(whole), 32, np.uint32)), w, at + n)


def feature_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket: summed in tasks, then by Spark; one number a bucket comes back."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for w in words_of(batch["text"], ALPHANUMERIC):
                for _, bucket in _features(w, longest, buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(met), "n": pa.array(sums[met])})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of add-one shares in target and source, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of seed and doc_id (null: none), rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


#: Best first: higher score, then smaller doc_id (null last), then the number of the row.
KEY = ["minus", "no_id", "id", "nth"]


def _key() -> Column:
    return F.struct((-F.col("score")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "nth")


def _literal(key: tuple) -> Column:
    kinds = ("long", "boolean", "long", "long")
    return F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(key, kinds, KEY)])


def kth_key(rows: DataFrame, k: int, seed: int, stored: Stored, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) of the different keys in the column ``key``, by quickselect; None if there are fewer.

    Each round draws ``pivots`` keys at random from the open rows, counts exactly how many open keys lie below and at each
    of them, and goes on with the rows between the two pivots around the k-th, which are written. Rows of a round are
    about one in ``pivots`` of those before, so all rounds together read little more than the first; the driver sees only
    pivots and counts.
    """
    if k < 1:
        return None
    open_rows, round_, held = rows.select("key"), 0, None
    while True:
        draw = open_rows.orderBy(F.xxhash64(F.lit(seed), F.lit(round_), "key.nth"), "key").limit(pivots).collect()
        chosen = sorted(tuple(r["key"]) for r in draw)
        if not chosen:
            return None
        sums = [F.count_if(c) for p in chosen for c in (F.col("key") < _literal(p), F.col("key") == _literal(p))]
        got = list(open_rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first())
        low = high = None
        below = 0
        for p, less, same in zip(chosen, got[::2], got[1::2]):
            if less < k <= less + same:
                if held is not None:
                    stored.drop(held)
                return p
            if less + same < k:
                low, below = p, less + same
            elif high is None:
                high = p
        if low is not None:
            open_rows = open_rows.where(F.col("key") > _literal(low))
        if high is not None:
            open_rows = open_rows.where(F.col("key") < _literal(high))
        k, round_ = k - below, round_ + 1
        narrowed = stored.save(open_rows, "open")
        if held is not None:
            stored.drop(held)
        open_rows = held = narrowed


def ranked(rows: DataFrame, stored: Stored) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``key`` as ``rank``: ranges are sorted apart, and begin after those before."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    dealt = stored.save(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, at = {}, 0
    for r in sorted(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each range
        before[r["part"]], at = at, at + r["n"]
    bases = F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]) if before else F.lit(None).cast("map<bigint,bigint>")
    return dealt.withColumn("rank", (bases[part] + place + 1).cast("long")).drop("__at")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, pivots: int = PIVOTS) -> DataFrame:
    """Weigh every document by how much likelier its n-grams are in ``target`` than in ``docs``, and draw by weight plus Gumbel noise.

    One scan counts the features of either table in hashed buckets; tasks of a second one add up an array of bucket gains
    for each document. Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down)
    with the highest scores are drawn: a distributed quickselect finds the last one's key, and only those drawn are sorted.
    Ties go to the smaller doc_id (null last); rows that repeat a doc_id are separate rows, in any order.

    A to Z count in lower case; words are runs of ASCII letters and digits and of all beyond ASCII. A null or empty text
    has no words and weighs 0. An empty table gives no rows; an empty target leaves all gains defined, by add-one counts.
    Further columns are not read.

    Returns doc_id, n_features, weight, score, rank (null for rows not drawn).
    """
    spark = docs.sparkSession
    stored = Stored(spark, "resampling")
    gains = bucket_gains(feature_counts(docs, longest, buckets), feature_counts(target, longest, buckets))

    def weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch["text"], ALPHANUMERIC):
                n = len(w.count)
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for doc, bucket in _features(w, longest, buckets):
                    features += np.bincount(doc, minlength=n)
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                    edge = np.searchsorted(doc, np.arange(n + 1))
                    weight += sums[edge[1:]] - sums[edge[:-1]]
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(w.first, n), "n_words": pa.array(w.count), "n_features": pa.array(features), "weight": pa.array(weight)})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scored = plain.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("nth", F.monotonically_increasing_id())
    scored = stored.save(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words).withColumn("key", _key())
    last = kth_key(able, able.count() * percent // 100, seed, stored, pivots)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (_key() <= _literal(last))
    rest = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(able.where(F.col("key") <= _literal(last)), stored).select(*columns, "rank").unionByName(rest)
