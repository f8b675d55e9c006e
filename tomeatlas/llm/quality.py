"""Quality classifier: a generalised additive model with pairwise interactions, read from lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.labelled import SAMPLE, training_rows
from tomeatlas.llm.words import BLANK, NOT_BLANK, windows, words_of

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "symbols", "rare_symbols", "upper", "digits", "blanks", "line_ends",
    "stops", "beyond_ascii", "distinct_words", "distinct_pairs", "commonest_word", "repeats", "short_words", "long_words",
)
_B = np.arange(256)
_CLASSES = {
    "symbols": (_B > 32) & (_B < 127) & ~np.char.isalnum(_B.astype(np.uint8).view("S1")),
    "rare_symbols": np.isin(_B, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]),
    "upper": (_B >= 65) & (_B <= 90), "digits": (_B >= 48) & (_B <= 57), "blanks": BLANK, "line_ends": _B == 10,
    "stops": np.isin(_B, [ord(c) for c in ".!?"]), "beyond_ascii": _B >= 128,
}


def _runs_per_text(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes, and count of the commonest, of each text."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner = (key[edge] >> np.uint64(40)).astype(np.int64)
    size = np.diff(np.append(edge, len(key)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, size)
    return np.bincount(owner, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; texts without words have zeros where words are counted."""
    parts = [np.zeros((0, len(FEATURES)), np.float32)]
    for w in words_of(texts, NOT_BLANK):
        n, doc = len(w.count), w.doc - w.first
        size = np.diff(w.offsets).astype(float)
        f = {"log_bytes": np.log1p(size), "log_words": np.log1p(w.count)}
        for name, members in _CLASSES.items():
            sums = np.concatenate([[0], np.cumsum(members[w.raw], dtype=np.int64)])
            f[name] = (sums[w.offsets[1:]] - sums[w.offsets[:-1]]) / np.maximum(size, 1)
        words, length = np.maximum(w.count, 1), (w.end - w.start).astype(float)
        per = lambda values: np.bincount(doc, weights=values, minlength=n) / words  # noqa: E731, B023
        f["word_bytes"] = per(length)
        f["word_bytes_spread"] = np.sqrt(np.maximum(per(length**2) - f["word_bytes"] ** 2, 0))
        f["short_words"], f["long_words"] = per(length <= 2), per(length >= 12)
        different, most = _runs_per_text(doc, w.hash, n)
        f["distinct_words"], f["commonest_word"] = different / words, most / words
        pairs, at = windows(w, 2)
        f["distinct_pairs"] = _runs_per_text(doc[at], pairs, n)[0] / np.maximum(w.count - 1, 1)
        again = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0)
        f["repeats"] = per(again)
        parts.append(np.stack([f[name] for name in FEATURES], axis=1).astype(np.float32))
    return np.concatenate(parts)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; a score adds one entry of each table."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, table in self.pairs:
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1 if gain[i] > 0 else 0


def _leaves(g: np.ndarray, h: np.ndarray, penalty: float, depth: int) -> np.ndarray:
    """Value of each bin in the tree of ``depth`` that fits gradients best, cut by cut."""
    at = _cut(g, h, penalty)[1] if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.concatenate([_leaves(g[:at], h[:at], penalty, depth - 1), _leaves(g[at:], h[at:], penalty, depth - 1)])


def _pair_leaves(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts one feature and then, on either side, the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for i in range(1, len(a)):
            sides = [(a[:i].sum(0), b[:i].sum(0)), (a[i:].sum(0), b[i:].sum(0))]
            gain = sum(_cut(*s, penalty)[0] + s[0].sum() ** 2 / (s[1].sum() + penalty) for s in sides) - a.sum() ** 2 / (b.sum() + penalty)
            if gain > best[0]:
                rows = [_leaves(*s, penalty, 1) for s in sides]
                cells = np.repeat(np.stack(rows), [i, len(a) - i], axis=0)
                best = (float(gain), cells.T if turned else cells)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, n_pairs: int = 6, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.15, penalty: float = 2.0) -> AdditiveModel:
    """Boost shallow trees, one feature after the other in each round; then the same for the pairs that explain most of what is left."""
    if len(np.unique(y)) < 2:
        return AdditiveModel(base=0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    model = AdditiveModel(_edges(x, bins), [], _edges(x, pair_bins))
    share = y.mean()
    model.base = float(np.log(share / (1 - share)))
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for table, at in zip(model.tables, binned):
            p = 1 / (1 + np.exp(-z))
            step = rate * _leaves(np.bincount(at, y - p, len(table)), np.bincount(at, p * (1 - p), len(table)), penalty, 2)
            table += step
            z += step[at]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, key, shape = 1 / (1 + np.exp(-z)), coarse[a] * wide[b] + coarse[b], (wide[a], wide[b])
        return np.bincount(key, y - p, wide[a] * wide[b]).reshape(shape), np.bincount(key, p * (1 - p), wide[a] * wide[b]).reshape(shape)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -_pair_leaves(*cells(*ab), penalty)[0])[:n_pairs]
    model.pairs = [(a, b, np.zeros((wide[a], wide[b]))) for a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            step = rate * _pair_leaves(*cells(a, b), penalty)[1]
            table += step
            z += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on the features of at most about ``sample`` labelled rows; only their numbers reach the driver."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(batch["text"])
            yield pa.record_batch([batch["doc_id"], batch["y"], *(pa.array(c) for c in f.T)], names=["doc_id", "y", *FEATURES])

    rows = training_rows(docs, labels, label, keep, sample)
    got = rows.mapInArrow(numbers, "doc_id long, y int, " + ", ".join(f"{n} float" for n in FEATURES)).toPandas().sort_values("doc_id")
    return fit(got[list(FEATURES)].to_numpy(), got["y"].to_numpy(float))


def with_scores(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, 0 to 1; one of that name is replaced.

    A null or empty text is scored like any other, with zero features. Every row is scored on its own, so repeated
    rows and an empty table need no rule.
    """
    names = [c for c in docs.columns if c != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(features(batch["text"]))
            yield pa.record_batch([*(batch[c] for c in names), pa.array(score)], names=[*names, column])

    out = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(scored, f"{kinds}, `{column}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, keep=None, label: str = "quality", sample: int = SAMPLE, column: str = "score") -> DataFrame:
    """Score every document for quality with a model fitted on labelled ones for which ``keep`` holds.

    Without labelled rows every score is 0.5; labels and ids never enter a score. See ``with_scores``.
    """
    model = train(docs, labels, label, F.lit(True) if keep is None else keep, sample)
    return with_scores(docs, model, column)
