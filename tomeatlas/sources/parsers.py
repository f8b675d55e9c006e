"""Records of catalogues, the knowledge graph and contributed sheets as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import ColumnLike, col, items, strip, text
from tomeatlas.functions.geo import parse_point
from tomeatlas.functions.text import (
    author_of,
    cover_url,
    form_genres,
    iso_year,
    loose_year,
    sheet_language,
    uri_tail,
)
from tomeatlas.operators.dedup import dedup_first
from tomeatlas.operators.joins import geocode

_BINDING_FIELDS = [
    "book", "bookLabel", "place", "placeLabel", "coord", "author", "authorLabel", "pubDate", "langLabel",
    "countryLabel", "genreLabels",
]
BINDING = "struct<" + ",".join(f"{f}:struct<value:string>" for f in _BINDING_FIELDS) + ">"


def parse_narrative_bindings(df: DataFrame, column: str = "binding") -> DataFrame:
    """Book-place rows of graph query bindings (JSON text with ``ord``).

    The first row of each (book, place) counts, before its coordinate is looked at; a pair whose
    first coordinate is malformed is lost, as later rows of it were already skipped.
    """
    b = df.select("ord", F.from_json(column, BINDING).alias("b"))

    def value(name: str) -> Column:
        return F.col(f"b.{name}.value")

    rows = b.select(
        "ord",
        uri_tail(value("book")).alias("book_qid"),
        text(value("bookLabel")).alias("book_label"),
        uri_tail(value("place")).alias("place_qid"),
        text(value("placeLabel")).alias("place_label"),
        parse_point(value("coord")).alias("at"),
        value("authorLabel").alias("author_label"),
        uri_tail(value("author")).alias("author_qid"),
        iso_year(value("pubDate")).alias("publication_year"),
        value("langLabel").alias("language_label"),
        value("countryLabel").alias("country_label"),
        F.filter(
            F.transform(F.split(text(value("genreLabels")), r"\|"), lambda g: strip(g)), lambda g: g != ""
        ).alias("genre_labels"),
    )
    first = dedup_first(rows, ["book_qid", "place_qid"])
    return (
        first.filter(F.col("at").isNotNull())
        .withColumns({"longitude": F.col("at.lon"), "latitude": F.col("at.lat")})
        .drop("at")
    )


_DOC = (
    "struct<key:string,title:string,author_name:array<string>,first_publish_year:int,subject_places:array<string>,"
    "subject:array<string>,language:array<string>,cover_i:bigint,number_of_pages_median:int,edition_count:int>"
)
SEARCH_RESPONSE = f"struct<numFound:bigint,docs:array<{_DOC}>>"


def parse_catalogue_docs(df: DataFrame, column: str = "response", keep: Sequence[str] = ("ord",)) -> DataFrame:
    """Book rows of catalogue search responses, with their place in the answer."""
    docs = df.select(*keep, F.posexplode(F.from_json(column, SEARCH_RESPONSE)["docs"]).alias("position", "d"))
    return docs.select(
        *keep, "position",
        text("d.key").alias("work_key"),
        text("d.title").alias("title"),
        items("d.author_name").alias("authors"),
        F.col("d.first_publish_year").alias("first_publish_year"),
        items("d.subject").alias("subjects"),
        items("d.subject_places").alias("subject_places"),
        items("d.language").alias("languages"),
        F.col("d.cover_i").alias("cover_id"),
        cover_url("d.cover_i").alias("cover_url"),
        F.col("d.number_of_pages_median").alias("page_count"),
        F.coalesce("d.edition_count", F.lit(0)).alias("edition_count"),
    )


def parse_work_json(df: DataFrame, column: str = "work") -> DataFrame:
    """Description, cover and subjects of work records, whose fields may be text or objects."""
    record = F.try_parse_json(F.col(column))

    def string_at(path: str) -> Column:
        return F.try_variant_get(record, path, "string")

    is_text = F.schema_of_variant(F.try_variant_get(record, "$.description", "variant")) == "STRING"
    description = F.coalesce(
        string_at("$.description.value"), F.when(is_text, string_at("$.description")), F.lit("")
    )
    covers = F.try_variant_get(record, "$.covers", "array<variant>")
    cover = F.get(
        F.filter(F.transform(covers, lambda c: F.try_variant_get(c, "$", "bigint")), lambda c: c > 0), F.lit(0)
    )
    subjects = F.try_variant_get(record, "$.subjects", "array<variant>")

    def subject(s: Column) -> Column:
        plain = F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string"))
        return F.coalesce(F.try_variant_get(s, "$.name", "string"), plain)

    named = F.array_compact(F.transform(subjects, subject))
    return df.withColumns({"description": description, "cover_id": cover, "subjects": items(named)})


def pick_label(json_map: ColumnLike, languages: Sequence[str], field: str = "value") -> Column:
    """Label in the first language that has one, else of the lexically first other language."""
    labels = F.from_json(col(json_map), f"map<string,struct<{field}:string>>")

    def of(lang: str) -> Column:
        return F.nullif(strip(F.element_at(labels, F.lit(lang))[field]), F.lit(""))

    usable = F.filter(
        F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.element_at(labels, k)[field]), lambda v: strip(v) != ""
    )
    return F.coalesce(*[of(x) for x in languages], F.get(usable, F.lit(0)))


def site_title(json_map: ColumnLike, site: str = "enwiki") -> Column:
    """Article title of one site among an entity's links."""
    links = F.from_json(col(json_map), "map<string,struct<title:string>>")
    return F.element_at(links, F.lit(site))["title"]


def parse_contribution_sheet(
    df: DataFrame, gazetteer: DataFrame, prefix: str = "cif", source: str = "citiesinfiction", region: str = "South Asia"
) -> tuple[DataFrame, DataFrame]:
    """(entries, unresolved) of a contributed sheet: sheet_row, title, author, city, form, theme,
    language, year, comments. Rows without title or city are skipped."""

    def cell(c: str) -> Column:
        return F.when(strip(c) == "None", F.lit("")).otherwise(strip(c))

    usable = df.filter((strip("title") != "") & (cell("city") != ""))
    placed = geocode(usable, gazetteer, "city")
    people, year = author_of("author"), loose_year(F.col("year").cast("string"))
    passage = F.concat_ws(" ", F.nullif(cell("theme"), F.lit("")), F.nullif(cell("comments"), F.lit("")))
    slugged = F.replace(F.lower("display_city"), F.lit(" "), F.lit("-"))
    entries = placed.filter(F.col("lon").isNotNull()).select(
        F.col("sheet_row").cast("bigint").alias("ord"),
        F.concat(F.lit(f"{prefix}-"), F.col("sheet_row").cast("string"), F.lit("-"), slugged).alias("id"),
        strip("title").alias("book_title"),
        people["author"].alias("author"),
        people["translator"].alias("translator"),
        F.coalesce(year, F.lit(0)).alias("publish_year"),
        F.col("display_city").alias("place_name"),
        "lon", "lat",
        F.lit("real").alias("place_type"), F.lit("primary").alias("setting_type"),
        F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(year.cast("string"), F.lit("s"))).otherwise(F.lit("")).alias("narrative_era"),
        passage.alias("passage"),
        F.lit(0.0).alias("polarity"), items(F.lit(None)).alias("emotions"), items(F.lit(None)).alias("themes"),
        sheet_language("language").alias("language"),
        form_genres("form").alias("genres"),
        F.lit(region).alias("region"), F.lit(source).alias("source"),
    )
    return entries, placed.filter(F.col("lon").isNull()).select("sheet_row", "city")
