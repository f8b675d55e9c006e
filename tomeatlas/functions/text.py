"""Text normalisation, labels and vocabulary look-ups (column in, column out)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import (
    WHITESPACE_RUN,
    ColumnLike,
    col,
    first_contained,
    items,
    let,
    lookup,
    records,
    strings,
    strip,
    text,
)

# Patterns and addresses.
COMPOSITE = r"(?iU)\s*(?:;|/|\||&|\band\b)\s*"
BRACKETED = r"\(.*?(\w+)\)"
TRANSLATOR = r"(?i);\s*(?:translated|trans\.)\s*(?:by|into)?\s*"
QID = r"^Q\d+$"
COVERS = "https://covers.openlibrary.org/b/id/"
CATALOGUE = "https://openlibrary.org"
GRAPH = "https://www.wikidata.org/wiki/"
SEARCH = "https://www.google.com/search?q="
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def norm_text(c: ColumnLike) -> Column:
    """Lower case, outer white space gone, inner runs collapsed to one blank."""
    return F.trim(F.lower(F.regexp_replace(text(c), WHITESPACE_RUN, " ")))


def slug(c: ColumnLike) -> Column:
    s = F.btrim(F.regexp_replace(norm_text(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("unknown")).otherwise(s)


# ---- places ----

def canonical_city(c: ColumnLike, aliases: Mapping[str, str] = vocab.TITLE_CITY_ALIASES) -> Column:
    n = norm_text(c)
    return F.coalesce(lookup(n, aliases), n)


def historical_name(c: ColumnLike, names: Mapping[str, str] = vocab.HISTORICAL_NAMES) -> Column:
    """Present name of a place known under a former one, null otherwise."""
    return lookup(F.lower(strip(c)), names)


def sheet_city(c: ColumnLike, aliases: Mapping[str, str] = vocab.SHEET_CITY_ALIASES) -> Column:
    """``struct(display, query)`` of a free-form city cell."""
    raw = strip(c)
    alias = first_contained(F.lower(raw), {k.lower(): v for k, v in aliases.items()})
    before_comma = strip(F.split_part(raw, F.lit(","), F.lit(1)))
    before_slash = strip(F.split_part(raw, F.lit("/"), F.lit(1)))
    bracketed = F.regexp_extract(raw, BRACKETED, 1)
    three_words = F.array_join(F.slice(F.split(raw, WHITESPACE_RUN), 1, 3), " ")
    long = F.length(raw) > 40
    display = (
        F.when(alias.isNotNull(), alias)
        .when(F.contains(raw, F.lit(",")), before_comma)
        .when(F.contains(raw, F.lit("/")), before_slash)
        .when(long & (bracketed != ""), bracketed)
        .when(long, three_words)
        .otherwise(raw)
    )
    query = (
        F.when(alias.isNotNull(), alias)
        .when(F.contains(raw, F.lit(",")), raw)
        .when(F.contains(raw, F.lit("/")), before_slash)
        .when(long & (bracketed != ""), bracketed)
        .otherwise(raw)
    )
    return F.struct(display.alias("display"), query.alias("query"))


def composite_parts(c: ColumnLike) -> Column:
    """Atomic names of a label such as "A and B; C", cleaned, distinct, in order."""
    cleaned = F.transform(
        F.split(text(c), COMPOSITE),
        lambda p: F.trim(F.regexp_replace(F.btrim(p, F.lit(" ,.-")), WHITESPACE_RUN, " ")),
    )
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def is_composite(c: ColumnLike) -> Column:
    """Whether the label names more than one place (repeats count)."""
    return F.size(F.filter(F.split(text(c), COMPOSITE), lambda p: strip(p) != "")) > 1


# ---- languages ----

def clean_language(c: ColumnLike, labels: Mapping[str, str] = vocab.LANGUAGE_LABELS) -> Column:
    return F.coalesce(lookup(norm_text(c), labels), col(c))


def primary_language(codes: ColumnLike, names: Mapping[str, str] = vocab.LANGUAGE_CODES) -> Column:
    """Name of the first known language code, English when none is known."""
    known = F.filter(F.transform(items(codes), lambda x: lookup(x, names)), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("English"))


def sheet_language(c: ColumnLike, parts: Mapping[str, str] = vocab.LANGUAGE_PARTS) -> Column:
    raw = F.rtrim(strip(c), F.lit(")"))
    return F.when(text(c) == "", F.lit("English")).otherwise(
        F.coalesce(first_contained(F.lower(raw), parts), raw)
    )


# ---- genres and themes from subjects ----

def _labels_in(subjects: ColumnLike, pairs: Mapping[str, str]) -> Column:
    joined = F.lower(F.array_join(items(subjects), " "))
    return let(
        joined,
        lambda s: F.array_sort(
            F.array_distinct(
                F.array_compact(F.array(*[F.when(F.contains(s, F.lit(k)), F.lit(v)) for k, v in pairs.items()]))
            )
        ),
    )


def catalogue_genres(subjects: ColumnLike, pairs: Mapping[str, str] = vocab.SUBJECT_GENRES) -> Column:
    return let(
        _labels_in(subjects, pairs),
        lambda g: F.when(F.size(g) > 0, g).otherwise(strings(["literary fiction"])),
    )


def catalogue_themes(subjects: ColumnLike, pairs: Mapping[str, str] = vocab.SUBJECT_THEMES) -> Column:
    return _labels_in(subjects, pairs)


def subject_genres(
    subjects: ColumnLike,
    pairs: Mapping[str, str] = vocab.SUBJECT_GENRES_DETAILED,
    ignored: Sequence[str] = vocab.IGNORED_SUBJECTS,
) -> Column:
    """Genre of each subject (first key it contains), distinct, in subject order."""
    table = records([{"key": k, "genre": v} for k, v in pairs.items()], "key:string,genre:string")

    def classify(subject: Column) -> Column:
        low = F.lower(strip(subject))
        hit = F.get(F.filter(table, lambda p: F.contains(low, p["key"])), F.lit(0))["genre"]
        return F.when(~low.isin(*ignored) & (F.length(low) >= 3), hit)

    return F.array_distinct(F.array_compact(F.transform(items(subjects), classify)))


def form_genres(form: ColumnLike, forms: Mapping[str, Sequence[str]] = vocab.FORM_GENRES) -> Column:
    hit = first_contained(F.lower(strip(form)), {k: "|".join(v) for k, v in forms.items()})
    return F.split(F.coalesce(hit, F.lit("literary fiction")), r"\|")


# ---- numbers, identifiers, names in cells ----

def iso_year(c: ColumnLike) -> Column:
    """Year from the first four characters of an ISO date, null when they are no number."""
    return F.substring(col(c), 1, 4).try_cast("int")


def loose_year(c: ColumnLike) -> Column:
    """Whole year from text such as "1999" or "1999.0"."""
    s = strip(c)
    return F.when(s.rlike(f"^{NUMBER}$"), s).try_cast("double").try_cast("int")


def uri_tail(c: ColumnLike) -> Column:
    return F.substring_index(text(c), "/", -1)


def is_qid(c: ColumnLike) -> Column:
    return strip(c).rlike(QID)


def author_of(c: ColumnLike) -> Column:
    """``struct(author, translator)`` of a cell such as "A; translated by B"."""
    raw = strip(c)
    parts = F.split(raw, TRANSLATOR)
    translated = F.contains(F.lower(raw), F.lit("translat")) & (F.size(parts) >= 2)
    author = F.when(translated, strip(F.get(parts, F.lit(0)))).otherwise(
        strip(F.split_part(raw, F.lit(";"), F.lit(1)))
    )
    translator = F.when(translated, strip(F.get(parts, F.lit(1))))
    return F.struct(author.alias("author"), F.nullif(translator, F.lit("")).alias("translator"))


# ---- presentation ----

def truncated(c: ColumnLike, limit: int, mark: str = "") -> Column:
    """At most ``limit`` characters of a passage, with a mark where something was cut."""
    s = text(c)
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit(mark))).otherwise(s)


def url_key(c: ColumnLike) -> Column:
    """URL-safe base64 without padding."""
    encoded = F.translate(F.base64(F.encode(text(c), "UTF-8")), "+/\r\n", "-_")
    return F.rtrim(encoded, F.lit("="))


def theme_label(c: ColumnLike) -> Column:
    """Display form: underscores to blanks, each word capitalised, the rest left as it is."""
    words = F.split(F.regexp_replace(text(c), "_", " "), r"(?<=\W)|(?=\W)")
    capital = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(capital, "")


def decade(year: ColumnLike) -> Column:
    return F.concat((F.floor(col(year) / 10) * 10).cast("string"), F.lit("s"))


ERAS = ["Pre-1900", "1900–1950", "1950–1980", "1980–2000", "2000–present"]


def era_bucket(year: ColumnLike) -> Column:
    y = F.coalesce(col(year), F.lit(0))
    return (
        F.when(y < 1900, F.lit(ERAS[0]))
        .when(y < 1950, F.lit(ERAS[1]))
        .when(y < 1980, F.lit(ERAS[2]))
        .when(y < 2000, F.lit(ERAS[3]))
        .otherwise(F.lit(ERAS[4]))
    )


def cover_url(cover_id: ColumnLike, size: str = "M") -> Column:
    c = col(cover_id).cast("string")
    url = F.concat(F.lit(COVERS), c, F.lit(f"-{size}.jpg"))
    return F.when(col(cover_id) != 0, url)


def work_url(work_key: ColumnLike) -> Column:
    return F.concat(F.lit(CATALOGUE), col(work_key))


def same_as(book_id: ColumnLike, url: ColumnLike, key: ColumnLike) -> Column:
    """Links that identify the same work elsewhere."""
    wiki = F.when(text(book_id) != "", F.concat(F.lit(GRAPH), col(book_id)))
    work = F.when(text(url) != "", col(url)).when(text(key) != "", work_url(key))
    return F.array_compact(F.array(wiki, work))


def search_link(title: ColumnLike, author: ColumnLike) -> Column:
    phrase = F.replace(strip(F.concat(text(title), F.lit(" "), text(author))), F.lit(" "), F.lit("+"))
    return F.concat(F.lit(SEARCH), phrase, F.lit("+book"))

