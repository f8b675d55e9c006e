"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.labelled import SAMPLE, training_rows
from tomeatlas.llm.shared_files import read_arrays, write_arrays
from tomeatlas.llm.stored import Stored, remove

SIZES = (4, 5, 6)
BITS = 20
#: Characters taken at once.
PIECE = 1 << 20
#: Matrix entries of a file, which a step of the fit takes at once.
_ENTRIES = 1 << 22
_M = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last, text of each n-gram, its bucket); characters are code points in lower case."""
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (chars == 0 or chars + len(texts[last]) <= PIECE):
            chars += len(texts[last])
            last += 1
        low = [f" {t.lower()} " for t in texts[first:last]]
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        length = np.array([len(t) for t in low])
        doc = np.repeat(np.arange(first, last), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters to the end of the text
        h = np.zeros(len(code), np.uint64)
        docs, buckets = [], []
        for n in range(1, max(SIZES) + 1):
            if n > len(code):
                break
            h = (h[: len(code) - n + 1] + code[n - 1 :]) * _M
            h ^= h >> np.uint64(29)
            if n in SIZES:
                whole = left[: len(h)] >= n
                docs.append(doc[: len(h)][whole])
                buckets.append(((h[whole] * _M) >> np.uint64(64 - BITS)).astype(np.int32))
        yield first, last, np.concatenate(docs) if docs else doc[:0], np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        first = last


def present(texts: list[str]) -> Iterator[np.ndarray]:
    """Of each text, every bucket that it has, once."""
    place = np.zeros(1 << BITS, np.int32)
    for first, last, doc, bucket in grams(texts):
        cuts = np.flatnonzero(np.diff(doc) < 0) + 1  # the n-grams of each size come in the order of the texts
        sizes = [(b, np.searchsorted(d, np.arange(first, last + 1))) for d, b in zip(np.split(doc, cuts), np.split(bucket, cuts))]
        for i in range(last - first):
            own = np.concatenate([b[at[i] : at[i + 1]] for b, at in sizes])
            order = np.arange(len(own), dtype=np.int32)
            place[own] = order  # of equal buckets one stays
            yield own[place[own] == order]


@dataclass
class LinearModel:
    weights: np.ndarray  # of each bucket
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.bias + np.fromiter((self.weights[b].sum() for b in present(texts)), float, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Matrix:
    """Which texts have which buckets, in files that are gone through one by one; nothing of their size is held."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Label and number of buckets of each text, and the buckets."""
        for path in self.paths:
            arrays, _ = read_arrays.__wrapped__(path)  # not kept
            yield arrays["y"], arrays["length"], arrays["bucket"]

    def counts(self) -> np.ndarray:
        """In how many texts of label 0 and 1 each bucket occurs."""
        out = np.zeros((2, 1 << BITS))
        for y, length, bucket in self.pieces():
            positive = np.bincount(bucket, np.repeat(y, length), 1 << BITS)
            out += np.stack([np.bincount(bucket, minlength=1 << BITS) - positive, positive])
        return out

    def loss(self, w: np.ndarray, b: float, values: np.ndarray) -> tuple[float, np.ndarray, float]:
        """Sum of the logistic losses, and its gradient by w and b; each bucket stands for its value."""
        loss, by_w, by_b, scaled = 0.0, np.zeros(1 << BITS), 0.0, values * w
        for y, length, bucket in self.pieces():
            z, some = np.full(len(y), b), np.flatnonzero(length)
            if len(some):
                z[some] += np.add.reduceat(scaled[bucket], (np.cumsum(length) - length)[some])
            loss += float((np.logaddexp(0, z) - y * z).sum())
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            by_w += np.bincount(bucket, np.repeat(r, length), 1 << BITS)
            by_b += float(r.sum())
        return loss, values * by_w, by_b


def logistic(matrix: Matrix, values: np.ndarray, n: int, share: float, penalty: float, steps: int = 80, near: float = 1e-4, memory: int = 6) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression on ``n`` texts, by limited-memory BFGS.

    It ends when the gradient is ``near`` times as long as at first, or after ``steps`` passes over the matrix.
    """

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, by_w, by_b = matrix.loss(x[:-1], x[-1], values)
        return loss / n + penalty / 2 * float(x[:-1] @ x[:-1]), np.append(by_w / n + penalty * x[:-1], by_b / n)

    x = np.append(np.zeros(len(values)), np.log((share + 1e-3) / (1 - share + 1e-3)))
    f, g = at(x)
    left, small, moves = steps - 1, near * float(np.linalg.norm(g)), []
    while left > 0 and float(np.linalg.norm(g)) > small:
        d, used = -g, []
        for s, u in reversed(moves):
            used.append(float(s @ d) / float(s @ u))
            d = d - used[-1] * u
        d = d * (float(moves[-1][0] @ moves[-1][1]) / float(moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(g))))
        for s, u in moves:
            d = d + (used.pop() - float(u @ d) / float(s @ u)) * s
        slope, step = float(g @ d), 1.0
        while left > 0:
            new = x + step * d
            f_new, g_new = at(new)
            left -= 1
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 3
        else:
            break
        s, u = new - x, g_new - g
        if float(s @ u) > 1e-12 * float(u @ u):
            moves = [*moves, (s, u)][-memory:]
        x, f, g = new, f_new, g_new
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int = SAMPLE, smooth: float = 1.0, penalty: float = 2e-4) -> LinearModel:
    """Fit on at most about ``sample`` labelled rows; every n-gram (bucket) that one of them has gets a weight.

    Tasks write which buckets each text has, 4 bytes for each, in files of the shared folder. The driver goes through them
    file by file: for the smoothed shares of the buckets in the two classes, whose log ratio scales a bucket, and
    for each step of the fit. It holds numbers for the buckets and one file.
    """
    spark = docs.sparkSession
    stored = Stored(spark, "toxicity")
    rows = stored.save(training_rows(docs, labels, label, keep, sample), "sample")
    classes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        stored.drop(rows)
        return LinearModel(np.zeros(1 << BITS), {(): 0.0, (0,): -4.0, (1,): 4.0}[tuple(classes)])
    place = stored.path("matrix")
    folder = place if "://" in place or place.startswith("/") else place.replace("file:", "file://", 1)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, buckets, held = [], [], 0

        def file() -> pa.RecordBatch:
            arrays = {"y": np.array(ys, np.int32), "length": np.array([len(b) for b in buckets], np.int64), "bucket": np.concatenate(buckets)}
            return pa.record_batch({"path": pa.array([write_arrays(folder, "rows", arrays, {})])})

        for batch in batches:
            for y, bucket in zip(batch["y"].to_pylist(), present(batch["text"].to_pylist())):
                ys.append(y)
                buckets.append(bucket)
                held += len(bucket)
                if held >= _ENTRIES:
                    yield file()
                    ys, buckets, held = [], [], 0
        if ys:
            yield file()

    few = min(12, rows.rdd.getNumPartitions())  # the sample is bounded
    matrix = Matrix(sorted(r["path"] for r in rows.coalesce(few).mapInArrow(written, "path string").collect()))
    stored.drop(rows)
    neg, pos = matrix.counts()
    seen = neg + pos > 0
    ratio = np.where(seen, np.log((pos + smooth) / (pos + smooth)[seen].sum()) - np.log((neg + smooth) / (neg + smooth)[seen].sum()), 0.0)
    n = classes[0] + classes[1]
    w, b = logistic(matrix, ratio, n, classes[1] / n, penalty)
    remove(spark, place)
    return LinearModel(w * ratio, b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep=None, label: str = "toxic", sample: int = SAMPLE, column: str = "score") -> DataFrame:
    """Score the whole text of every document for toxicity, 0 to 1, with a model fitted on labelled ones for which ``keep`` holds.

    A null or empty text gets the score of a text without any n-gram of the sample. Without labelled rows every score
    is 0.5. Rows are scored one by one, so repeated rows and an empty table need no rule; labels and ids never enter a
    score. All columns of ``docs`` are returned; one named like ``column`` is replaced.
    """
    model = train(docs, labels, label, F.lit(True) if keep is None else keep, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: a number for each bucket
    names = [c for c in docs.columns if c != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores([t or "" for t in batch["text"].to_pylist()])
            yield pa.record_batch([*(batch[c] for c in names), pa.array(score)], names=[*names, column])

    out = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(scored, f"{kinds}, `{column}` double")
