"""Words and word windows of many texts at once, as numpy arrays over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a longer text is taken alone.
PIECE = 1 << 19

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Everything but ASCII blanks.
NOT_BLANK = ~BLANK
#: ASCII digits and letters and all beyond ASCII.
ALPHANUMERIC = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a run of texts: number of the text in its batch, position of the word in the text, hash."""

    first: int  # the run's first text
    count: np.ndarray  # words per text
    doc: np.ndarray
    pos: np.ndarray
    hash: np.ndarray
    start: np.ndarray  # in data
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes
    raw: np.ndarray  # bytes as they were
    offsets: np.ndarray  # of the texts in data


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = end - start
    h = mixed(size.astype(np.uint64) * _M1 + _M3)
    todo = np.arange(len(start))
    step = 0
    while len(todo):
        left = size[todo] - step
        part = eight[start[todo] + step]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[todo] = mixed((h[todo] + part) * _M1 + np.uint64(step + 1))
        step += 8
        todo = todo[left > 8]
    return h


def words_of(texts: pa.Array, in_word: np.ndarray, piece: int = PIECE) -> Iterator[Words]:
    """Words of each text, lower-casing A to Z, in runs of about ``piece`` bytes."""
    data, at = utf8(texts)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(int(np.searchsorted(at, at[first] + piece, side="right")) - 1, first + 1)
        run, off = LOWER[data[at[first] : at[last]]], at[first : last + 1] - at[first]
        inside = in_word[run]
        cut = np.zeros(len(run) + 1, bool)
        cut[off] = True
        before, after = np.zeros(len(run), bool), np.zeros(len(run), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | cut[:-1]))
        end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        doc = np.searchsorted(off, start, side="right") - 1
        count = np.bincount(doc, minlength=last - first)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        yield Words(first, count, doc + first, pos, word_hashes(run, start, end), start, end, run, data[at[first] : at[last]], off)
        first = last


def windows(w: Words, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, or of those from the words ``at``, and the index of the first word in ``w``."""
    if at is None:
        n = max(len(w.hash) - k + 1, 0)
        at = np.flatnonzero(w.doc[:n] == w.doc[len(w.doc) - n :])
    h = np.full(len(at), k, np.uint64) * _M3
    for j in range(k):
        h = mixed(h * _M1 + w.hash[at + j])
    return h, at
