"""Predicates on titles, authors and subjects: reference works, ambiguous and misplaced titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import (
    ColumnLike,
    any_word,
    col,
    contains_any,
    items,
    let,
    quoted,
    strip,
    text,
)
from tomeatlas.functions.text import canonical_city, norm_text


def is_nonfiction_title(title: ColumnLike = "book_title") -> Column:
    """Title worded like a reference work and not on the safelist."""
    t = norm_text(title)
    return ~t.isin(*vocab.NONFICTION_SAFELIST) & t.rlike(any_word(vocab.NONFICTION_TITLE_WORDS))


def nonfiction_reason(
    title: ColumnLike = "book_title",
    author: ColumnLike = "author",
    genres: ColumnLike = "genres",
    passage: ColumnLike = "passage",
) -> Column:
    """Why a row is not fiction, null when it is kept."""
    t, g, p = F.lower(text(title)), items(genres), F.lower(text(passage))
    settled = [x for x in vocab.FICTION_GENRES if x != "literary fiction"]
    keep = (
        t.isin(*vocab.KEPT_TITLES)
        | F.lower(text(author)).isin(*vocab.KEPT_AUTHORS)
        | F.arrays_overlap(g, F.lit(settled))
    )
    reason = F.when(keep, F.lit(None).cast("string"))
    for pattern in vocab.REPORT_TITLE_WORDS:
        reason = reason.when(t.rlike("(?U)" + pattern), F.lit(f"title matches: {pattern}"))
    for pattern in vocab.REPORT_TEXT_PATTERNS:
        reason = reason.when(p.rlike(pattern), F.lit(f"description matches: {pattern}"))
    factual = ["biography", "memoir", "social realism", "essay"]
    only_factual = (F.size(g) > 0) & F.forall(g, lambda x: x.isin(*factual))

    def only(name: str) -> Column:
        return only_factual & F.forall(g, lambda x: x == name)

    return (
        reason.when(only_factual & F.array_contains(g, "biography"), F.lit("pure biography"))
        .when(only("social realism"), F.lit("pure social realism (likely nonfiction)"))
        .when(only("memoir"), F.lit("pure memoir"))
        .when(only("essay"), F.lit("pure essay/nonfiction"))
        .when(F.contains(t, F.lit("autobiography")), F.lit("autobiography in title"))
    )


def is_likely_fiction(
    title: ColumnLike = "title", authors: ColumnLike = "authors", subjects: ColumnLike = "subjects"
) -> Column:
    """Catalogue record that is neither study notes nor a reference work."""
    t = F.lower(strip(title))
    a = F.lower(F.array_join(items(authors), " "))
    s = F.lower(F.array_join(items(subjects), " "))
    notes = contains_any(t, vocab.BLOCKED_TITLE_PARTS) | contains_any(a, vocab.BLOCKED_AUTHOR_PARTS)
    reference = contains_any(s, vocab.REFERENCE_SUBJECT_PARTS) & ~contains_any(s, vocab.FICTION_SUBJECT_PARTS)
    return (t != "") & ~notes & ~reference


def suspected_nonfiction(title: ColumnLike = "book_title") -> Column:
    return contains_any(F.lower(text(title)), vocab.SUSPECT_TITLE_PARTS)


def is_ambiguous_title(title: ColumnLike = "book_title") -> Column:
    t = norm_text(title)
    return (F.length(t) <= 2) | t.rlike(r"^q\d+$") | t.isin(*vocab.GENERIC_TITLES)


def title_cities(title: ColumnLike = "book_title") -> Column:
    """Distinct known cities that the title mentions by name, alias or inhabitants."""
    pairs = [*vocab.TITLE_CITY_ALIASES.items(), *vocab.CITY_DEMONYMS.items()]
    return let(
        norm_text(title),
        lambda t: F.array_distinct(
            F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)), F.lit(v)) for k, v in pairs]))
        ),
    )


def is_title_city_mismatch(title: ColumnLike = "book_title", place: ColumnLike = "place_name") -> Column:
    """The title mentions exactly one known city and the row is set elsewhere."""
    place = canonical_city(place)
    return F.coalesce(
        let(title_cities(title), lambda m: (F.size(m) == 1) & (F.get(m, F.lit(0)) != place)), F.lit(False)
    )


def title_geo_mismatch(title: ColumnLike = "book_title", place: ColumnLike = "place_name") -> Column:
    """Some city named in the title is missing from the place."""
    t, p = F.lower(strip(title)), F.lower(strip(place))
    checks = [F.contains(t, F.lit(c)) & ~F.contains(p, F.lit(c)) for c in vocab.TITLE_CITY_TOKENS]
    out = checks[0]
    for check in checks[1:]:
        out = out | check
    return out


def mentions_city(c: ColumnLike, cities: list[str] = vocab.FULLTEXT_CITIES) -> Column:
    """First city named in the text as it is spelt there, empty when none is."""
    return F.regexp_extract(col(c), r"(?iU)\b(" + "|".join(quoted(cities)) + r")\b", 1)
