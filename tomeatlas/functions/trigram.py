"""Trigram similarity: words padded with two blanks before and one after, sets compared."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeatlas.functions.expr import ColumnLike, let, strings, text


def trigrams(c: ColumnLike) -> Column:
    """Distinct trigrams of a text."""
    words = F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def query_trigrams(query: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return sorted({f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)})


def similarity(c: ColumnLike, query: str) -> Column:
    """Shared trigrams over all trigrams of the column and a constant query."""
    wanted = query_trigrams(query)

    def score(found: Column) -> Column:
        shared = F.size(F.array_intersect(found, strings(wanted)))
        union = F.size(found) + F.lit(len(wanted)) - shared
        return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)

    return let(trigrams(c), score)
