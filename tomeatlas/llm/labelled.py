"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import with_empty_text

#: Most rows a classifier is fitted on, as expected over the draw; rows are drawn by a hash of doc_id.
SAMPLE = 30_000
_STEPS = 1 << 30


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, text, y of about ``sample`` documents with a label of 0 or 1 for which ``keep`` holds.

    Only ids and labels of the sample, whose size is bounded, are broadcast; texts are not shuffled. If a doc_id has
    several labels the highest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rate = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < int(rate * _STEPS))
    return with_empty_text(docs).join(F.broadcast(drawn), "doc_id")
