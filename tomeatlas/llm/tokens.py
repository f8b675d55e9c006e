"""Ids of the lower-casing word tokenizer, with a memory of words seen before."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark import Broadcast

from tomeatlas.llm.cross_tokens import _byte_letters

#: Characters whose classes are the same in every version of Unicode; texts with others go to the tokenizer whole.
_LATIN = re.compile(r"[\x00-\u024f]*")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind) for kind in "LN")
#: The tokenizer's blanks among them; Python's own class has U+001C to U+001F besides.
_BLANKS = r"\x09-\x0d\x20\x85\xa0"
#: The tokenizer's own rule for pieces (a fixed value that must match the tokenizer file).
PIECES = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: Their ids stand for these strings even in ordinary text.
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Most words kept in memory by one worker process.
KNOWN = 300_000
#: Most bytes of a word whose pairs are merged by rank; the other library goes about longer ones in another way.
SHORT = 99
#: Bytes of lower-case letters up to U+024F, and what stands for each one at the end of a word, where it is another symbol.
_LETTER_BYTES = frozenset([*range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC2, 0xCA)])
_LAST_BYTES = frozenset(b for b in _LETTER_BYTES if b < 0xC0)
_LAST = [bytes([(b - 0x20 if b < 0x80 else b - 0x80) % 256]) for b in range(256)]
#: The tokenizer's mark at the end of a word's last token.
_END = "</w>"


def _merged(parts: list[bytes], merges: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Neighbours of the least merge, and of those the first ones, become one until none are left to merge."""
    none = 1 << 62
    while len(parts) > 1:
        order = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        least = min(order)
        if least == none:
            break
        i = order.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@cache
def word_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of the tokens that words of letters can have; None if merging what spells the least id does not give a word's ids.

    It does if ids follow the order of merges and the symbols of each token merge to that token: neighbours that spell a
    token came about as they do in the token's own string, so they are the two that its merge names. This goes through
    all tokens (most of a second), so it is meant to be done once, on the driver.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _END or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    letters, vocab = _byte_letters(), model["vocab"]

    def symbols(token: str) -> bytes | None:
        raw = [letters.get(c, 0) for c in token.removesuffix(_END)]
        if not raw or not _LETTER_BYTES.issuperset(raw):
            return None
        if not token.endswith(_END):
            return bytes(raw)
        return bytes(raw[:-1]) + _LAST[raw[-1]] if raw[-1] in _LAST_BYTES else None

    spelled = {token: symbols(token) for token in vocab}
    ranks = {raw: vocab[token] for token, raw in spelled.items() if raw}
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab[x + y] for x, y in pairs]
    merges = {(spelled[x], spelled[y]): i for i, (x, y) in enumerate(pairs) if spelled[x] and spelled[y]}
    alike = all(i < j for i, j in zip(ids, ids[1:])) and ranks.keys() >= {*(bytes([b]) for b in _LETTER_BYTES), *(_LAST[b] for b in _LAST_BYTES)}
    return ranks if alike and all(len(_merged([bytes([b]) for b in raw], merges)) == 1 for raw in ranks) else None


class _Memory(dict):
    """Ids of words met before, in two halves: when the newer one is full the older one goes, and words met again move up."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of, self.older = ids_of, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.ids_of(word)
        if len(self) >= KNOWN // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    """Encodes each distinct word once: the tokenizer treats the pieces of a text apart from each other.

    With ``ranks`` (``word_ranks`` of the same file) another library encodes words of letters, at less cost.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.known = _Memory(self._ids)
        self.ranks = None
        if ranks:
            import tiktoken

            self.ranks = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.four = [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]

    def _ids(self, word: str) -> bytes:
        if self.ranks and word.isalpha() and len(raw := word.encode()) <= SHORT:
            four = self.four
            return b"".join([four[i] for i in self.ranks._encode_single_piece(raw[:-1] + _LAST[raw[-1]])])
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.inner.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        low = text if text.isascii() else unicodedata.normalize("NFC", text)
        low = low.lower()
        if not (low.isascii() or _LATIN.fullmatch(low)) or _SPECIAL.search(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, PIECES.findall(low)))


_of_path: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str, ranks: Broadcast) -> WordTokenizer:
    """One for a worker process, whose memory later tasks use as well; ``ranks`` is read for the first of them only."""
    if path not in _of_path:
        _of_path[path] = WordTokenizer(path, ranks.value)
    return _of_path[path]
