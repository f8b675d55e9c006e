"""Tokens of two tokenizers over one text, cut where both end at the same byte, and links between their ids."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that one output batch covers; a longer text is taken alone.
RUN = 4 << 20
#: Stretches kept in memory by one worker process.
KNOWN = 300_000
#: Longer stretches are not remembered.
LONG = 48

_SPACE = "▁"
#: Between the stretches of a text that is taken apart; such texts lack it, as it counts as a blank.
_MARK = "\x1f"
#: Blanks at which a text may be taken apart; texts with other blanks are encoded whole.
_OTHER_BLANKS = re.compile(r"[^\S \n\t]")
_STRETCH = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
#: The byte-level tokenizer's own rule for pieces (a fixed value that must match the tokenizer).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WITHIN = re.compile(rf"{_SPACE}*[^{_SPACE} \n\t]*")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(unseen)}


class ByteTokens:
    """The byte-level tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said["pre_tokenizer"] or {}
        #: Pieces of its pattern never reach from a word into the blanks behind it.
        self.cuttable = said["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        letters, ids = _byte_letters(), said["model"]["vocab"]
        self.bytes = [b""] * self.inner.get_vocab_size()
        for token, i in self.inner.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if token in ids else token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        self.ranks = None
        if self.cuttable and all(ids.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and len(ids) <= 257 + len(merges):
            import tiktoken

            # ids in the order of merges are ranks: for short strings the other library gives the same ids at less cost
            ranked = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranked, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_stretches(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of stretches of a text, as they are inside of it: all in their order, in lists of any length."""
        if not self.ranks:
            yield from self.encode(texts)
            return
        for blank, some in groupby(texts, str.isspace):
            # stretches with a word stay apart in one text, while blanks would run into those that follow
            yield from map(self.ranks.encode_ordinary, some if blank else ["".join(some)])


class PieceTokens:
    """The piece tokenizer, which puts a space before a text: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.inner = SentencePieceProcessor(model_file=path)
        names = [self.inner.id_to_piece(i) for i in range(self.inner.get_piece_size())]
        self.space = self.inner.piece_to_id(_SPACE)
        #: No piece reaches from a word into the blanks behind it.
        self.cuttable = names[self.space] == _SPACE and all(map(_WITHIN.fullmatch, names))
        self.bytes = [bytes([int(n[3:5], 16)]) if self.inner.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1)

    def encode_stretches(self, texts: list[str]) -> list[list[int]]:
        """Ids of each of the stretches of a text, as they are inside of it."""
        # the tokenizer's own space stands for the first one; other stretches go behind a line feed, which no piece has
        own = self.encode([t[1:] if t[0] == " " else "\n" + t for t in texts])
        return [(ids or [self.space]) if t[0] == " " else ids[2:] for t, ids in zip(texts, own)]


def common_slices(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """The ids between each two places where tokens of both end: a dictionary from end to index for either side, and the ends in both."""
    index_a, index_b, end, i, j = {}, {}, 0, 0, 0
    for t in a:
        end += size_a[t]
        i += 1
        index_a[end] = i
    end = 0
    for t in b:
        end += size_b[t]
        j += 1
        index_b[end] = j
    i = j = 0
    for end in sorted(index_a.keys() & index_b.keys()):
        yield a[i : index_a[end]], b[j : index_b[end]]
        i, j = index_a[end], index_b[end]


class Aligner:
    """Slices and links of texts, from those of their stretches (blanks and the word behind them), which are remembered.

    When the memory is full it stays as it is, and other stretches are encoded again in each run.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.cuttable = self.a.cuttable and self.b.cuttable
        self.size_a, self.size_b = [[len(x) for x in side.bytes] for side in (self.a, self.b)]
        self.sizes = np.array(self.size_a), np.array(self.size_b)
        self.name_a, self.name_b = [[str(i) for i in range(len(side.bytes))] for side in (self.a, self.b)]
        #: Names with what may follow: within a side, at the end of A's side; within a side, behind a slice, behind a stretch.
        self.names = [n + end for names, ends in ((self.name_a, ",|"), (self.name_b, ",;\n")) for end in ends for n in names]
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.pairs, self.first_pair = array("q"), array("q", [0])
        self.facts = array("q")  # n_a, n_b, n_groups of each stretch
        self.kept = 0

    def _add(self, a: list[int], b: list[int]) -> int:
        names_a, names_b, groups = self.name_a, self.name_b, []
        for x, y in common_slices(a, b, self.size_a, self.size_b):
            groups.append(f"{','.join([names_a[t] for t in x])}|{','.join([names_b[t] for t in y])}")
            self.pairs.append(x[-1] * len(names_b) + y[-1])  # in a slice only the last tokens end together
        self.text.append(";".join(groups))
        self.first_pair.append(len(self.pairs))
        self.facts.extend((len(a), len(b), len(groups)))
        return len(self.text) - 1

    def _spelled(self, side: ByteTokens | PieceTokens, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Of each stretch, if its ids (from ``first`` on) spell it and none of them is without bytes."""
        end = np.concatenate([[0], np.cumsum(sizes[ids])])[first]
        empty = np.concatenate([[0], np.cumsum(sizes[ids] == 0)])[first]
        right = (np.diff(end) == np.fromiter(map(len, raw), np.int64, len(raw))) & (np.diff(empty) == 0)
        said = b"".join(map(side.bytes.__getitem__, ids.tolist()))
        if not right.all() or said != b"".join(raw):
            right &= np.fromiter((said[i:j] == r for i, j, r in zip(end[:-1].tolist(), end[1:].tolist(), raw)), bool, len(raw))
        return right

    def _add_all(self, stretches: list[str]) -> np.ndarray:
        """Adds stretches at once, as ``_add`` does one; their numbers, -1 for those that either side's ids do not spell."""
        raw, (size_a, size_b) = [s.encode() for s in stretches], self.sizes
        bound = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a = np.fromiter(chain.from_iterable(self.a.encode_stretches(stretches)), np.int64)
        first_a = np.concatenate([[0], np.searchsorted(np.cumsum(size_a[a]), bound, side="right")])
        lists = self.b.encode_stretches(stretches)
        b = np.fromiter(chain.from_iterable(lists), np.int64)
        first_b = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        right = self._spelled(self.a, a, size_a, first_a, raw) & self._spelled(self.b, b, size_b, first_b, raw)
        code = np.where(right, len(self.text) + np.cumsum(right) - 1, -1)
        if not right.any():
            return code
        n_a, n_b, total = np.diff(first_a), np.diff(first_b), int(first_a[-1])
        a, b = a[: total][np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b = n_a[right], n_b[right]
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        # the last token of each slice, on either side; every stretch ends with a slice
        last_a = np.searchsorted(end_a, end_b)
        last_b = np.flatnonzero(end_a[last_a] == end_b)
        last_a = last_a[last_b]
        slices = np.searchsorted(last_b, np.cumsum(n_b) - 1) + 1  # up to the end of each stretch
        pairs = a[last_a] * len(size_b) + b[last_b]
        # names in the order of the text: each slice's tokens of A, then those of B
        name_a, name_b = a.copy(), 2 * len(size_a) + b
        name_a[last_a] += len(size_a)
        name_b[last_b] += len(size_b)
        name_b[last_b[slices - 1]] += len(size_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))] = name_a
        order[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = name_b
        self.text += "".join(map(self.names.__getitem__, order.tolist())).split("\n")[:-1]
        self.first_pair.frombytes((len(self.pairs) + slices).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())
        self.facts.frombytes(np.stack([n_a, n_b, np.diff(slices, prepend=0)], axis=1).astype(np.int64).tobytes())
        return code

    def _forget(self) -> None:
        """Drop what the last run has had beside the memory."""
        del self.text[self.kept :], self.first_pair[self.kept + 1 :], self.facts[3 * self.kept :]
        del self.pairs[self.first_pair[-1] :]

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b.bytes.__getitem__, b))

    def _whole(self, text: str) -> list[int]:
        a, b = self.a.encode([" " + text])[0], self.b.encode([text])[0]
        return [self._add(a, b)] if self._same(" " + text, a, b) else []

    def _cut(self, text: str) -> str | None:
        """A text with marks between its stretches, without the space that most begin with; None if it may not be taken apart.

        One that begins with a space and another blank keeps both and starts with a carriage return, which such texts lack.
        """
        if not self.cuttable or _OTHER_BLANKS.search(text):
            return None
        if "\t" not in text:
            cut = text.replace("\n", " \n").replace(" ", _MARK)
            if cut[0] != _MARK and cut[-1] not in f"{_MARK}\n" and _MARK + _MARK not in cut and f"\n{_MARK}" not in cut:
                return cut
        return _MARK.join([s if s[0] != " " else "\r" + s if s[1:2] in ("\n", "\t") else s[1:] for s in _STRETCH.findall(" " + text)])

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Numbers of stretches not in memory, from the shortest on, -1 for those whose texts are encoded whole; what has room is remembered."""
        new = sorted(new, key=len)  # those to remember come first
        code = self._add_all([s[s[0] == "\r" :] if s and s[0] in "\n\t\r" else " " + s for s in new]).tolist()
        known = self.code
        for s, c in zip(new, code):
            if len(s) > LONG or len(known) >= KNOWN:
                break
            if c >= 0:
                known[s] = c
                self.kept = c + 1
        return dict(zip(new, code))

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the different stretches of some texts, the place there of each stretch in order, and where each text's places begin.

        A text without tokens has none. The numbers are good until the next call.
        """
        self._forget()
        cut = [self._cut(t) if t else None for t in texts]
        lists = pc.split_pattern(pa.array(cut, pa.string()), _MARK)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        met = lists.flatten().dictionary_encode()
        found, at = met.dictionary.to_pylist(), met.indices.to_numpy()
        code = list(map(self.code.get, found))
        if None in code:
            own = self._learn([s for s, c in zip(found, code) if c is None])
            code = [own[s] if c is None else c for s, c in zip(found, code)]
        code = np.array(code, np.int64)
        whole = [i for i, (t, c) in enumerate(zip(texts, cut)) if t and c is None]
        if (code < 0).any():
            odd = np.unique(np.repeat(np.arange(len(texts)), size)[code[at] < 0])
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            at = at[np.repeat(keep, size)]
            size[odd] = 0
            whole = sorted([*whole, *odd.tolist()])
            at, code = (np.cumsum(code >= 0) - 1)[at], code[code >= 0]
        if whole:
            first = np.cumsum(size) - size
            more = [(i, c) for i in whole for c in self._whole(texts[i])]
            at = np.insert(at, [first[i] for i, _ in more], np.arange(len(code), len(code) + len(more)))
            code = np.append(code, np.array([c for _, c in more], np.int64))
            size[[i for i, _ in more]] = 1
        return code, at, np.concatenate([[0], np.cumsum(size)])

    def codes(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's stretches, none for a text without tokens; good until the next call."""
        code, at, edge = self.stretches(texts)
        return [code[at[i:j]].tolist() for i, j in zip(edge[:-1], edge[1:])]

    def pairs_of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of stretches, one stretch after the other, and how many each has."""
        first = np.array(self.first_pair, np.int64)
        n = first[code + 1] - first[code]
        return np.array(self.pairs, np.int64)[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for a worker process, whose memory later tasks use as well."""
    return Aligner(path_a, path_b)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= RUN:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How many links of all documents hold each pair of ids: a, b, n, highest (n is the most that b has with any a).

    A task sums the occurrences of each different stretch first, and sends pairs once. Of linked tokens one ends with the
    other's bytes, so there are at most as many pairs as the tokens of both vocabularies have bytes together, however
    many documents there are.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        size = len(aligner.b.bytes)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in _runs(batch["text"]):
                code, at, _ = aligner.stretches(texts)
                pairs, own = aligner.pairs_of(code)
                n = np.repeat(np.bincount(at, minlength=len(code)), own)
                keys, back = np.unique(np.concatenate([keys, pairs[n > 0]]), return_inverse=True)
                sums = np.bincount(back, weights=np.concatenate([sums, n[n > 0]]), minlength=len(keys)).astype(np.int64)
        yield pa.record_batch({"a": pa.array((keys // size).astype(np.int32)), "b": pa.array((keys % size).astype(np.int32)), "n": pa.array(sums)})

    sent = docs.select(F.col("text").alias("text")).mapInArrow(counted, "a int, b int, n long")
    pairs = sent.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.withColumn("highest", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def linked_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Slices of every text at the byte offsets where tokens of both tokenizers end, and facts of its links over all documents.

    Tokenizer A is a byte-level one that gets the text after a space, B a piece tokenizer that puts the space itself.
    Cumulative ends of either side are the keys of a dictionary to token numbers; the sorted keys in both slice the two
    id lists. A link is a pair of tokens, one of A and one of B, whose bytes end together: the last ones of a slice. One
    scan counts the links of each pair of ids (``pair_counts``; that table, whose size the vocabularies bound, is
    sent to all tasks), a second one gives the rows; texts are neither shuffled nor stored.

    A text is taken apart into blanks and the word behind them where neither tokenizer's tokens can span the place, so
    that a task encodes a stretch it has met once; other texts are encoded whole. Texts that are null or empty, or that
    either side's tokens do not spell byte for byte, have no tokens and count zero. Rows are taken one by one: repeated
    rows count each, an empty table gives no rows, a null doc_id stays null, further columns are not read.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its B id), count_sum (of
    the pairs' counts over all links), groups ('a1,a2|b1;a3|b2': see ``slices``).
    """
    table = pair_counts(docs, path_a, path_b).select(F.struct("a", "b", "n", "highest").alias("p")).select("p.*").toArrow()
    a, b, n, highest = (table[c].to_numpy() for c in ("a", "b", "n", "highest"))
    sent = docs.sparkSession.sparkContext.broadcast((a, b, n, highest))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        a, b, n, highest = sent.value
        keys = a.astype(np.int64) * len(aligner.b.bytes) + b
        order = np.argsort(keys)
        keys, n, highest = np.append(keys[order], 1 << 62), np.append(n[order], 0), np.append(highest[order], False)
        for batch in batches:
            for first, texts in _runs(batch["text"]):
                code, at, edge = aligner.stretches(texts)
                pairs, own = aligner.pairs_of(code)
                place = np.searchsorted(keys, pairs)
                of_links = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([highest[place], n[place]], axis=1), axis=0)])
                end = np.cumsum(own)
                facts = np.concatenate([np.array(aligner.facts, np.int64).reshape(-1, 3)[code], of_links[end] - of_links[end - own]], axis=1)
                sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(facts[at], axis=0)])
                n_a, n_b, n_groups, n_best, total = (np.ascontiguousarray(x) for x in (sums[edge[1:]] - sums[edge[:-1]]).T)
                groups = pa.array([aligner.text[c] for c in code.tolist()], pa.string()).take(pa.array(at))
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(first, len(texts)), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_groups),
                    "n_best": pa.array(n_best), "count_sum": pa.array(total), "groups": pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), groups), ";"),
                })

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def slices(groups: str) -> Column:
    """The column ``groups`` of ``linked_tokens`` as array<struct<a: array<int>, b: array<int>>>."""
    sides = lambda g: F.struct(*[F.split(F.split(g, r"\|")[i], ",").cast("array<int>").alias(c) for i, c in enumerate("ab")])
    return F.when(F.col(groups) == "", F.array().cast("array<struct<a: array<int>, b: array<int>>>")).otherwise(F.transform(F.split(groups, ";"), sides))
