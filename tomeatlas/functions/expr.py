"""Small building blocks for column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# characters that count as white space when stripping (Unicode, not only the blank)
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnLike) -> Column:
    """The string, empty when missing."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: ColumnLike) -> Column:
    return F.btrim(text(c), F.lit(WHITESPACE))


def items(c: ColumnLike) -> Column:
    """The array, empty when missing."""
    return F.coalesce(col(c), F.array().cast("array<string>"))


def strings(values: Iterable[str]) -> Column:
    """Constant array: one text literal that the optimizer splits once, however long the list is."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def is_one_of(c: Column, values: Iterable[str]) -> Column:
    """Membership in a long constant list."""
    return F.array_contains(strings(values), c)


def lookup(key: Column, pairs: Mapping[str, str]) -> Column:
    """Value of ``key`` in a small constant map, null when absent."""
    entries = "\x1f".join(f"{k}\x1e{v}" for k, v in pairs.items())
    return F.element_at(F.str_to_map(F.lit(entries), F.lit("\x1f"), F.lit("\x1e")), key)


def records(rows: list[dict], schema: str) -> Column:
    """Constant array of structs, read once from one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    """Substring test against each part, as compiled code rather than a regular expression."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def first_contained(c: Column, pairs: Mapping[str, str]) -> Column:
    """Value of the first key that occurs in ``c``, null when none does."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in pairs.items()])


def any_word(phrases: Iterable[str]) -> str:
    """Pattern of whole-word alternatives (phrases are patterns themselves)."""
    return r"(?U)\b(?:" + "|".join(phrases) + r")\b"


def quoted(phrases: Iterable[str]) -> list[str]:
    return [re.escape(p) for p in phrases]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
