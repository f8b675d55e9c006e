"""n-gram language model in an Elias-Fano trie of memory-mapped files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.elias_fano import EliasFano, Packed
from tomeatlas.llm.shared_files import read_arrays, write_arrays
from tomeatlas.llm.stored import Stored, remove
from tomeatlas.llm.words import NOT_BLANK, Words, words_of

#: Stands for the end of a text, and for what comes before its first word.
END = np.uint64(0xA0761D6478BD642F)
#: Words of the longest n-grams, if not named.
ORDER = 3
#: Bytes of training text for each part of the trie.
PART_BYTES = 12 << 20
#: Bytes of training text for each occurrence that one part holds at most; a word with more is dealt over several parts.
TOKEN_BYTES = 6
#: Bytes of text that are taken apart and looked up at once.
RUN = 4 << 20
#: Different words that a task holds before it sends their counts.
HELD = 1_000_000

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


@dataclass
class _Run:
    """Tokens of a run of texts: of each text END, its words, and END again."""

    hash: np.ndarray  # the different tokens, ascending
    rank: np.ndarray  # of each token, its number among them
    doc: np.ndarray  # number of its text in the run
    pos: np.ndarray  # place in its text
    left: np.ndarray  # tokens behind it in its text

    @classmethod
    def of(cls, w: Words) -> _Run:
        n, size = len(w.count), w.count + 2
        tokens = np.full(int(size.sum()), END)
        tokens[np.arange(len(w.hash)) + 2 * (w.doc - w.first) + 1] = w.hash
        kinds, rank = np.unique(tokens, return_inverse=True)
        start = np.cumsum(size) - size
        pos = np.arange(len(tokens)) - np.repeat(start, size)
        return cls(kinds, rank.astype(np.uint64), np.repeat(np.arange(n), size), pos, np.repeat(size, size) - pos - 1)


def _part(h: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """Which of ``parts`` equal ranges a hash lies in."""
    return (((h >> _32) * np.asarray(parts).astype(np.uint64)) >> _32).astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    """A column of numbers: their bytes that are not always zero, all first ones, then all second ones, and so on."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _blocks(part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part that occurs."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        yield pa.record_batch({"part": pa.array([int(part[a])], pa.int32()), "columns": pa.array([[_packed(c[order[a:b]]) for c in columns]], pa.list_(pa.binary()))})


def _gathered(blocks: Iterable[pa.RecordBatch]) -> list[np.ndarray]:
    rows = [[_unpacked(raw) for raw in row] for b in blocks for row in b["columns"].to_pylist()]
    return [np.concatenate(c) for c in zip(*rows)]


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of ``keys`` in ascending order, first column first, with the sums of their counts."""
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) <= 64:
        whole = keys[0].copy()
        for k, b in zip(keys[1:], bits[1:]):
            whole = (whole << np.uint64(b)) | k
        order = np.argsort(whole)
    else:
        order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new)
    return [k[edge] for k in keys], np.add.reduceat(counts[order], edge)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each number and the 256 values that the bytes stand for: means of equal steps, so none is off by more than a step."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    codes = np.minimum((x - low) * (256 / max(high - low, 1e-12)), 255).astype(np.uint8)
    filled = np.bincount(codes, minlength=256)
    return codes, np.bincount(codes, weights=x, minlength=256) / np.maximum(filled, 1)


class _Level:
    """n-grams of one length in one part: pointers from the entries one word shorter to their followers, and these."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict, length: int):
        of = lambda name: arrays[f"{name}{length}"]
        self.start = EliasFano(facts[f"contexts{length}"] + 1, facts[f"bits{length}"], of("low"), of("high"), of("ones"))
        self.word = Packed(facts[f"width{length}"], of("word"))
        self.code, self.back_code = of("code"), of("back_code")
        self.value, self.back = 10 ** of("value"), 10 ** of("back")

    def child(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words among the followers of entries one level above, -1 if they are not; ``place`` ascends."""
        lo, hi = self.start[place].astype(np.int64), self.start[place + 1].astype(np.int64)
        at = self.word.successor(lo, hi, word)
        found = at < hi
        found[found] = self.word[at[found]] == word[found]
        return np.where(found, at, -1)


@lru_cache(maxsize=1 << 14)
def _levels(path: str, order: int) -> list[_Level]:
    arrays, facts = read_arrays(path)
    return [_Level(arrays, facts, length) for length in range(2, order + 1)]


@dataclass
class Model:
    """Places of the files and the few numbers that a lookup needs.

    Parts are ranges of word hashes. The n-grams that begin with a word are in the part of that word; those of a word with
    more occurrences than a part should hold are in parts of its own, by ranges of the hash of their second word.
    """

    order: int
    words: list[str]  # file of each range; "" for an empty one
    first_id: np.ndarray  # of each range, and the number of words at the end
    tokens: int  # in the training texts
    hot: np.ndarray  # hashes of the words with parts of their own, ascending
    hot_part: np.ndarray  # first part of each, and the number of parts at the end
    grams: list[str] = field(default_factory=list)  # file of each part
    hot_back: dict[int, float] = field(default_factory=dict)  # of the parts of such words, the share left to words not seen

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if unknown) and training counts of ascending hashes. Ids follow the order of the hashes."""
        out, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edge = np.searchsorted(_part(h, len(self.words)), np.arange(len(self.words) + 1))
        for p in np.flatnonzero(np.diff(edge)):
            if self.words[p]:
                a, own = read_arrays(self.words[p])[0], slice(edge[p], edge[p + 1])
                at = np.minimum(np.searchsorted(a["hash"], h[own]), len(a["hash"]) - 1)
                same = a["hash"][at] == h[own]
                out[own] = np.where(same, at + self.first_id[p], -1)
                counts[own] = np.where(same, a["count"][at], 0)
        return out, counts

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """Add-one probability of words by their counts; all unknown words share one."""
        return (counts + 1) / (self.tokens + int(self.first_id[-1]) + 1)

    def first_places(self, first: np.ndarray, first_id: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part of pairs of words by the hash and id of the first and the hash of the second, and the first one's place in it."""
        part = _part(first, len(self.words))
        place = first_id - self.first_id[part]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == first)
            begin = self.hot_part[at[own]]
            part[own] = begin + _part(second[own], self.hot_part[at[own] + 1] - begin)
            place[own] = 0
        return part, np.where(first_id >= 0, place, -1)

    def followers(self, length: int, part: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts (part, and place one level above, -1 if unknown) with a next word (id, -1 if unknown): the place
        of the n-gram (-1 if not seen), its discounted probability (0), and the share left to shorter contexts (1)."""
        node, p, back = np.full(len(place), -1, np.int64), np.zeros(len(place)), np.ones(len(place))
        known = np.flatnonzero(place >= 0)
        known = known[np.argsort(part[known], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(part[known]) != 0, [True]])) if len(known) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            own = known[a:b]
            path = self.grams[part[own[0]]]
            if not path:
                continue
            level = _levels(path, self.order)[length - 2]
            if length == 2 and (left := self.hot_back.get(int(part[own[0]]))) is not None:
                back[own], scale = left, 1 - left
            else:
                back[own], scale = level.back[level.back_code[place[own]]], 1.0
            own = own[word[own] >= 0]
            at = level.child(place[own], word[own])
            own, at = own[at >= 0], at[at >= 0]
            node[own], p[own] = at, level.value[level.code[at]] * scale
        return node, p, back


_WORDS = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("tokens", pa.int64()), ("hot", pa.list_(pa.int64()))])
_WORDS_SQL = "part int, path string, n long, tokens long, hot array<bigint>"
_GRAMS = pa.schema([("part", pa.int32()), ("path", pa.string()), ("followers", pa.int64()), ("n", pa.int64())])
_GRAMS_SQL = "part int, path string, followers long, n long"


def _write_levels(folder: str, contexts: int, columns: list[np.ndarray], counts: np.ndarray, vocabulary: int, hot_count: int | None) -> tuple[str, int, int]:
    """One part's file: of each length the pointers, words and coded probabilities of its n-grams, from the sorted longest ones.

    Columns after the first are ids plus one, 0 behind the end of a text. Returns path, first word's followers, their count.
    """
    arrays, facts = {}, {}
    new = np.zeros(len(counts), bool)
    new[0] = True
    new[1:] = columns[0][1:] != columns[0][:-1]
    entry = columns[0].astype(np.int64)
    for length, column in enumerate(columns[1:], 2):
        new[1:] |= column[1:] != column[:-1]
        there = column > 0
        begin = np.flatnonzero(new & there)
        n = np.add.reduceat(np.where(there, counts, 0), begin) if len(begin) else np.zeros(0, np.int64)
        parent = entry[begin]
        kinds = np.bincount(parent, minlength=contexts)
        of_context = np.bincount(parent, weights=n, minlength=contexts)
        if length == 2:
            followers, total = int(kinds[0]), int(of_context[0])
        back = np.where(kinds > 0, kinds / np.maximum(of_context + kinds, 1), 1.0)
        share = n / hot_count if length == 2 and hot_count else n / (of_context + kinds)[parent]
        start = EliasFano.of(np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64), len(begin))
        word = Packed.of(column[begin] - np.uint64(1), vocabulary)
        own = {**start.arrays(), "word": word.raw}
        own["code"], own["value"] = _coded(np.log10(share))
        own["back_code"], own["back"] = _coded(np.log10(back))
        arrays |= {f"{k}{length}": a for k, a in own.items()}
        facts |= {f"contexts{length}": contexts, f"bits{length}": start.low_bits, f"width{length}": word.width}
        entry, contexts = np.cumsum(new & there) - 1, len(begin)
    return write_arrays(folder, "grams", arrays, facts), followers, total


def train(docs: DataFrame, keep: Column, order: int = ORDER, part_bytes: int = PART_BYTES, folder: str | None = None) -> Model:
    """Count words and n-grams of up to ``order`` (2 at least) words of the texts for which ``keep`` holds, and write the trie.

    One scan counts words, a second one the longest n-grams; those a text's end cuts short are sent as they are, so that
    the counts of all shorter ones are sums. Tasks sum counts before they send them, sorted and in blocks. A part's task writes
    one file: for each length, Elias-Fano coded pointers from the entries one word shorter to their followers, the followers'
    ids in ascending order, a byte for each that names one of 256 values of its probability, and a byte for each context
    that names the share it leaves to words not seen. Parts grow in number with the text, not in size: a word with more
    occurrences than ``part_bytes`` of text have words is dealt over parts of its own (``Model``).

    The smoothing is Witten and Bell's, level by level: with n occurrences and k different followers of the context,
    p = (count + k * p_shorter) / (n + k). The stored probability is count / (n + k), the share k / (n + k). An n-gram
    does not reach beyond the END before its text, so the first words of a text have shorter contexts.
    """
    spark = docs.sparkSession
    folder = folder or Stored(spark, "model").path("trie")
    files = folder.replace("file:", "file://", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    texts = docs.where(keep).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // part_bytes + 1
    most = max(1, part_bytes // TOKEN_BYTES)

    def words_counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, ends = [], [], 0

        def sent():
            nonlocal hashes, counts, ends
            if ends:
                (h,), c = _summed([np.concatenate([*hashes, [END]])], np.concatenate([*counts, [ends]]))
                yield from _blocks(_part(h, parts), h, c)
            hashes, counts, ends = [], [], 0

        for batch in batches:
            for w in words_of(batch["text"], NOT_BLANK, RUN):
                h, c = np.unique(w.hash, return_counts=True)
                hashes.append(h)
                counts.append(c)
                ends += len(w.count)
                if sum(map(len, hashes)) > HELD:
                    yield from sent()
        yield from sent()

    def words_written(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = _gathered(blocks)
        (h,), c = _summed([h], c.astype(np.int64))
        path = write_arrays(files, "words", {"hash": h, "count": c}, {})
        hot = np.flatnonzero(c > most)
        yield pa.RecordBatch.from_pylist([{"part": key[0].as_py(), "path": path, "n": len(h), "tokens": int(c.sum()), "hot": [int(x) for i in hot for x in (h[i].view(np.int64), c[i])]}], _WORDS)

    blocks_sql = "part int, columns array<binary>"
    size, paths, hot = np.zeros(parts, np.int64), [""] * parts, []
    rows = texts.mapInArrow(words_counted, blocks_sql).groupBy("part").applyInArrow(words_written, _WORDS_SQL).collect()  # one for each part
    for r in rows:
        size[r["part"]], paths[r["part"]] = r["n"], r["path"]
        hot += [(np.int64(h).view(np.uint64), n) for h, n in zip(r["hot"][::2], r["hot"][1::2])]
    hot.sort()
    hot_parts = np.cumsum([parts, *[-(-n // most) for _, n in hot]])
    hot_count = {p: n for i, (_, n) in enumerate(hot) for p in range(hot_parts[i], hot_parts[i + 1])}
    model = Model(order, paths, np.concatenate([[0], np.cumsum(size)]), sum(r["tokens"] for r in rows), np.array([h for h, _ in hot], np.uint64), hot_parts)

    def grams_counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch["text"], NOT_BLANK, RUN):
                run = _Run.of(w)
                ids, _ = model.known(run.hash)
                begin = np.flatnonzero(run.left > 0)
                key, back, steps = run.rank[begin], None, []
                for j in range(1, order):
                    there = run.left[begin] >= j
                    nxt = np.where(there, run.rank[np.minimum(begin + j, len(run.rank) - 1)] + np.uint64(1), np.uint64(0))
                    key = (key << _32) | nxt
                    if j < order - 1:
                        key, back = np.unique(key, return_inverse=True)
                        steps.append(key)
                        key = back.astype(np.uint64)
                    else:
                        key, counts = np.unique(key, return_counts=True)
                columns = [key & _LOW]
                for step in steps[::-1]:
                    key = step[(key >> _32).astype(np.int64)]
                    columns.insert(0, key & _LOW)
                first, second = (key >> _32).astype(np.int64), columns[0].astype(np.int64) - 1
                part, place = model.first_places(run.hash[first], ids[first], run.hash[second])
                numbers = np.concatenate([[0], ids + 1]).astype(np.uint64)
                yield from _blocks(part, place.astype(np.uint64), *[numbers[c.astype(np.int64)] for c in columns], counts)

    def grams_written(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = key[0].as_py()
        *columns, counts = _gathered(blocks)
        columns, counts = _summed(columns, counts.astype(np.int64))
        path, followers, n = _write_levels(files, int(size[p]) if p < parts else 1, columns, counts, int(model.first_id[-1]), hot_count.get(p))
        yield pa.RecordBatch.from_pylist([{"part": p, "path": path, "followers": followers, "n": n}], _GRAMS)

    model.grams = [""] * int(hot_parts[-1])
    followers = dict.fromkeys(hot_count, 0)
    for r in texts.mapInArrow(grams_counted, blocks_sql).groupBy("part").applyInArrow(grams_written, _GRAMS_SQL).collect():
        model.grams[r["part"]] = r["path"]
        followers[r["part"]] = r["followers"]
    for i, (_, n) in enumerate(hot):
        own = range(hot_parts[i], hot_parts[i + 1])
        k = sum(followers[p] for p in own)
        model.hot_back |= dict.fromkeys(own, k / (n + k))
    return model


def language_scores(docs: DataFrame, keep: Column, order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Score every text with a model of n-grams of up to ``order`` words, from the texts for which ``keep`` holds (null: does not).

    Words are stretches without ASCII blanks, A to Z in lower case; a text has one more token, its end, and its first word
    follows an end. A null or empty text is its end alone. If nothing is kept for training every token is unknown.
    Rows are scored one by one, so repeated rows and an empty table need no rule.

    A task looks up the different n-grams of several megabytes of text together. The entry of an n-gram is the context of
    the next token, so each length costs one search among the followers of one entry. Scores are written, and the
    trie's files then removed.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model's log10
    probability).
    """
    stored = Stored(docs.sparkSession, "scores")
    folder = stored.path("trie")
    model = train(docs, F.coalesce(keep, F.lit(False)), order, part_bytes, folder)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch["text"], NOT_BLANK, RUN):
                run = _Run.of(w)
                ids, counts = model.known(run.hash)
                rank = run.rank.astype(np.int64)
                alone = model.alone(counts)
                p = alone[rank]
                # of each token, the number of the n-gram that ends there among the run's different ones; of these, part and place
                gram, part, place = run.rank, None, None
                for length in range(2, order + 1):
                    at = np.flatnonzero(run.pos >= length - 1)
                    kinds, back = np.unique((gram[at - 1] << _32) | run.rank[at], return_inverse=True)
                    context, word = (kinds >> _32).astype(np.int64), (kinds & _LOW).astype(np.int64)
                    if length == 2:
                        part, place = model.first_places(run.hash[context], ids[context], run.hash[word])
                    else:
                        part, place = part[context], place[context]
                    place, discounted, left = model.followers(length, part, place, ids[word])
                    p[at] = discounted[back] + left[back] * p[at]
                    gram = np.zeros(len(rank), np.uint64)
                    gram[at] = back.astype(np.uint64)
                n, own = len(w.count), run.pos > 0
                sums = lambda x: np.bincount(run.doc[own], weights=x[own], minlength=n)  # noqa: E731, B023
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(w.first, n), "n_tokens": pa.array(w.count + 1), "n_known": pa.array(sums((counts > 0)[rank]).astype(np.int64)),
                    "train_tokens": pa.array(np.full(n, model.tokens)), "base_score": pa.array(sums(np.log10(alone)[rank])), "score": pa.array(sums(np.log10(p))),
                })

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = stored.save(plain.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    remove(docs.sparkSession, folder)
    return out
