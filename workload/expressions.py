"""Column functions and derived columns over the place view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions import geo, quality, text, themes
from tomeatlas.operators.profiles import books_from_entries, book_composite_text
from tomeatlas.sources.writers import with_read_links
from workload.registry import query
from workload.tables import (
    has_any,
    joined,
    norm,
    places,
    sql_in,
    sql_list,
    sql_map,
    strip,
    words,
)

# ---- J: scalar functions ----


@query("j1_norm_text", f"select ord, {norm('book_title')} as title_key, {norm('passage')} as passage_key from places")
def _(spark, d):
    return places(spark, d).select(
        "ord", text.norm_text("book_title").alias("title_key"), text.norm_text("passage").alias("passage_key")
    )


@query(
    "j2_slug",
    f"""select ord, coalesce(nullif(trim(regexp_replace({norm('book_title')}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') as slug
    from places""",
)
def _(spark, d):
    return places(spark, d).select("ord", text.slug("book_title").alias("slug"))


# ---- O: the rules as SQL functions ----

_GRAMS = r"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
 lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def _in_sql(spark, d, statement):
    from tomeatlas.functions.sql import register_functions

    register_functions(spark)
    return spark.sql(statement, places=places(spark, d))


@query(
    "o_sql_text",
    f"""select ord, {norm('passage')} as passage_key, coalesce(nullif(trim(regexp_replace({norm('book_title')}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') as slug from places""",
)
def _(spark, d):
    return _in_sql(spark, d, "select ord, norm_text(passage) as passage_key, slug(book_title) as slug from {places}")


@query(
    "o_sql_distance",
    """with x as (select region, power(sin(radians(19.076 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.076)) * power(sin(radians(72.8777 - lon) / 2), 2) as a from places)
    select region, count(*) as entries, round(min(2 * 6371000.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0)))), 2) as nearest_m from x where 2 * 6371000.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))) <= 5000000 group by 1""",
)
def _(spark, d):
    return _in_sql(spark, d, "with x as (select region, haversine_m(lon, lat, 72.8777, 19.076) as m from {places}) select region, count(*) as entries, round(min(m), 2) as nearest_m from x where m <= 5000000 group by region")


@query(
    "o_sql_similarity",
    f"""with x as (select ord, {_GRAMS.format(x='place_name')} as a, {_GRAMS.format(x="region || ' nation'")} as b from places)
    select ord, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) as similarity from x""",
)
def _(spark, d):
    return _in_sql(spark, d, "select ord, round(trigram_similarity(place_name, region || ' nation'), 9) as similarity from {places}")


_CITY_CELLS = """select ord, case ord % 6 when 0 then place_name when 1 then 'Old Bombay, ' || place_name
 when 2 then place_name || '/' || region when 3 then place_name || ', ' || region
 when 4 then 'a long winding road that leads out of (' || place_name || ')'
 else 'a long winding road that leads away from ' || region end as cell, case ord % 3 when 0 then 'Bombay' when 1 then ' new york city ' else place_name end as spelling from places"""


def _city_cells(spark, d):
    m, name = F.col("ord") % 6, F.col("place_name")
    long = F.lit("a long winding road that leads ")
    cell = (
        F.when(m == 0, name).when(m == 1, F.concat(F.lit("Old Bombay, "), name))
        .when(m == 2, F.concat_ws("/", name, "region")).when(m == 3, F.concat_ws(", ", name, "region"))
        .when(m == 4, F.concat(long, F.lit("out of ("), name, F.lit(")")))
        .otherwise(F.concat(long, F.lit("away from "), F.col("region")))
    )
    n = F.col("ord") % 3
    spelling = F.when(n == 0, F.lit("Bombay")).when(n == 1, F.lit(" new york city ")).otherwise(name)
    return places(spark, d).select("ord", cell.alias("cell"), spelling.alias("spelling"))


@query(
    "j3_city_names",
    f"""with cells as ({_CITY_CELLS}),
    forms as (select *, regexp_extract(cell, '\\(.*?(\\w+)\\)', 1) as bracketed, string_split(cell, ' ') as w from cells)
    select ord,
     case when contains(lower(cell), 'bombay') then 'Mumbai'
      when contains(cell, ',') then trim(split_part(cell, ',', 1)) when contains(cell, '/') then trim(split_part(cell, '/', 1))
      when length(cell) > 40 and bracketed <> '' then bracketed
      when length(cell) > 40 then array_to_string(w[1:3], ' ') else cell end as display,
     case when contains(lower(cell), 'bombay') then 'Mumbai'
      when contains(cell, ',') then cell when contains(cell, '/') then trim(split_part(cell, '/', 1))
      when length(cell) > 40 and bracketed <> '' then bracketed else cell end as query,
     coalesce({sql_map(vocab.TITLE_CITY_ALIASES)}[trim(lower(spelling))], trim(lower(spelling))) as canonical,
     {sql_map(vocab.HISTORICAL_NAMES)}[trim(lower(spelling))] as modern
    from forms""",
)
def _(spark, d):
    return _city_cells(spark, d).select(
        "ord", text.sheet_city("cell")["display"].alias("display"), text.sheet_city("cell")["query"].alias("query"),
        text.canonical_city("spelling").alias("canonical"), text.historical_name("spelling").alias("modern"),
    )


@query(
    "j4_languages",
    f"""select ord, coalesce({sql_map(vocab.LANGUAGE_LABELS)}[lower(language)], language) as clean,
     case when ord % 2 = 0 then 'English' else {sql_map(vocab.LANGUAGE_CODES)}['hin'] end as main,
     case ord % 3 when 0 then 'Bengali' when 1 then 'English' else language || ' prose' end as sheet
    from places""",
)
def _(spark, d):
    even = F.col("ord") % 2 == 0
    codes = F.when(even, F.array(F.lit("xxx"), F.col("language"))).otherwise(F.array(F.lit("hin"), F.lit("eng")))
    m = F.col("ord") % 3
    cell = F.when(m == 0, F.lit(" Bangla (Dhaka)")).when(m == 1, F.lit("")).otherwise(F.concat("language", F.lit(" prose)")))
    return places(spark, d).select(
        "ord", text.clean_language("language").alias("clean"), text.primary_language(codes).alias("main"),
        text.sheet_language(cell).alias("sheet"),
    )


_SUBJECTS = """select ord, list_concat(genres, [replace(t, '_', ' ') for t in themes]) as subjects from places"""


def _subjects(spark, d):
    spelt = F.transform("themes", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    return places(spark, d).select("ord", F.concat("genres", spelt).alias("subjects"))


def _sql_labels_in(pairs):
    return f"list_sort(list_distinct([x.v for x in {_sql_pairs(pairs)} if contains(lower(array_to_string(subjects, ' ')), x.k)]))"


def _sql_pairs(pairs):
    rows = [f"{{'k': '{k}', 'v': '{v.replace(chr(39), chr(39) * 2)}'}}" for k, v in pairs]
    return "[" + ", ".join(rows) + "]"


@query(
    "j5_genres",
    f"""with s as ({_SUBJECTS}), c as (select *, {_sql_labels_in(vocab.SUBJECT_GENRES.items())} as found from s),
    per as (select ord, unnest(subjects) as subject, generate_subscripts(subjects, 1) as i from s),
    hit as (select ord, i, [x.v for x in {_sql_pairs(vocab.SUBJECT_GENRES_DETAILED.items())} if contains(lower(trim(subject)), x.k)][1] as g
     from per where length(lower(trim(subject))) >= 3 and lower(trim(subject)) not in {sql_in(vocab.IGNORED_SUBJECTS)}),
    firsts as (select ord, g, min(i) as i from hit where g is not null group by all),
    packed as (select ord, string_agg(g, '|' order by i) as detailed from firsts group by ord)
    select c.ord, array_to_string(case when len(found) > 0 then found else ['literary fiction'] end, '|') as catalogue,
     coalesce(detailed, '') as detailed,
     case c.ord % 3 when 0 then 'literary fiction' when 1 then 'short stories' else 'literary fiction' end as form
    from c left join packed using (ord)""",
)
def _(spark, d):
    m = F.col("ord") % 3
    form = F.when(m == 0, F.lit(" Novel")).when(m == 1, F.lit("Short story")).otherwise(F.lit("ballad"))
    return _subjects(spark, d).select(
        "ord", joined(text.catalogue_genres("subjects")).alias("catalogue"),
        joined(text.subject_genres("subjects")).alias("detailed"), joined(text.form_genres(form)).alias("form"),
    )


@query("j6_themes", f"with s as ({_SUBJECTS}) select ord, array_to_string({_sql_labels_in(vocab.SUBJECT_THEMES.items())}, '|') as themes from s")
def _(spark, d):
    return _subjects(spark, d).select("ord", joined(text.catalogue_themes("subjects")).alias("themes"))


@query(
    "j7_parse_point",
    """select ord, case when ord % 5 = 0 then null else lon end as lon, case when ord % 5 = 0 then null else lat end as lat
    from places""",
)
def _(spark, d):
    good = F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    bad = F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" north)"))
    p = places(spark, d).withColumn("p", geo.parse_point(F.when(F.col("ord") % 5 == 0, bad).otherwise(good)))
    return p.select("ord", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


@query(
    "j8_years",
    """select ord, case when ord % 4 = 3 or publish_year = 0 then null else publish_year end as iso,
     case when ord % 4 = 3 then null else publish_year end as loose from places""",
)
def _(spark, d):
    m, y = F.col("ord") % 4, F.col("publish_year").cast("string")
    iso = F.when(m == 3, F.concat(F.lit("c."), y)).otherwise(F.concat(y, F.lit("-01-01T00:00:00Z")))
    loose = F.when(m == 3, F.concat(F.lit("c. "), y)).otherwise(F.concat(y, F.lit(".0")))
    return places(spark, d).select(
        "ord", text.iso_year(iso).alias("iso"), text.loose_year(loose).alias("loose")
    )


@query(
    "j9_qid",
    """select ord, 'Q' || ord as qid, true as is_qid, false as title_is_qid from places""",
)
def _(spark, d):
    uri = F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("ord").cast("string"))
    return places(spark, d).select(
        "ord", text.uri_tail(uri).alias("qid"), text.is_qid(text.uri_tail(uri)).alias("is_qid"),
        text.is_qid("book_title").alias("title_is_qid"),
    )


@query(
    "j10_author_translator",
    """select ord, author, case when ord % 3 = 0 then region end as translator from places""",
)
def _(spark, d):
    m = F.col("ord") % 3
    cell = (
        F.when(m == 0, F.concat("author", F.lit(" ; Translated by "), "region"))
        .when(m == 1, F.concat("author", F.lit("; "), "region"))
        .otherwise(F.col("author"))
    )
    p = places(spark, d).withColumn("p", text.author_of(cell))
    return p.select("ord", F.col("p.author").alias("author"), F.col("p.translator").alias("translator"))


_NOISY = """select *, list_concat([upper(replace(t, '_', ' - ')) for t in themes], list_concat(themes, list_concat([' '], [book_title]))) as raw_themes,
 list_concat(['Eerie', ' obsessions'], list_concat(emotions, [upper(e) for e in emotions])) as raw_emotions from places"""


def _noisy(spark, d):
    shouted = F.transform("themes", lambda t: F.upper(F.replace(t, F.lit("_"), F.lit(" - "))))
    return places(spark, d).withColumns(
        {
            "raw_themes": F.concat(shouted, "themes", F.array(F.lit(" "), F.col("book_title"))),
            "raw_emotions": F.concat(
                F.array(F.lit("Eerie"), F.lit(" obsessions")), "emotions", F.transform("emotions", lambda e: F.upper(e))
            ),
        }
    )


def sql_clean_themes(x: str) -> str:
    """Ordered distinct list, as text."""
    cleaned = f"[trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '_') for t in {x}]"
    return sql_ordered_distinct(cleaned)


def sql_ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: t <> '' and list_position({x}, t) = i)"


@query(
    "j11_sanitize",
    f"""with n as ({_NOISY}) select ord, array_to_string({sql_clean_themes('raw_themes')}[1:6], '|') as themes,
    array_to_string({sql_ordered_distinct("[case lower(trim(e)) when 'eerie' then 'eeriness' when 'obsessions' then 'obsession' else lower(trim(e)) end for e in raw_emotions]")}[1:5], '|') as emotions,
    greatest(-1.0, least(1.0, polarity * 4)) as polarity from n""",
)
def _(spark, d):
    return _noisy(spark, d).select(
        "ord", joined(themes.sanitize_themes("raw_themes")).alias("themes"),
        joined(themes.sanitize_emotions("raw_emotions")).alias("emotions"),
        themes.clamp_polarity(F.col("polarity") * 4).alias("polarity"),
    )


TITLES = ["The Jungle of ", "Collected Works of ", "Comedy of Paris in ", "Dubliners", "London Calling ", "Madeline in "]
PLACES_AT = ["Paris", "Istanbul", "London", "NATION_1"]
_STAGED = f"""select ord, case ord % 6 when 3 then 'Dubliners' else {sql_list(TITLES)}[cast(ord % 6 as int) + 1] || author end as book_title,
 {sql_list(PLACES_AT)}[cast(ord % 4 as int) + 1] as place_name, genres, emotions,
 list_concat(themes, {sql_list(['salon_decadence', 'memory_of_protocol', 'identity_negotiation_experience', 'imperial_nostalgia'])}[1:cast(ord % 5 as int)]) as themes,
 polarity, passage from places"""


def _staged(spark, d):
    extra = F.array(*[F.lit(x) for x in ("salon_decadence", "memory_of_protocol", "identity_negotiation_experience", "imperial_nostalgia")])
    m6, m4 = (F.col("ord") % 6).cast("int"), (F.col("ord") % 4).cast("int")
    title = F.when(m6 == 3, F.lit("Dubliners")).otherwise(
        F.concat(F.element_at(F.array(*[F.lit(t) for t in TITLES]), m6 + 1), F.col("author"))
    )
    return places(spark, d).select(
        "ord", title.alias("book_title"), F.element_at(F.array(*[F.lit(t) for t in PLACES_AT]), m4 + 1).alias("place_name"),
        "genres", "emotions", F.concat("themes", F.slice(extra, F.lit(1), (F.col("ord") % 5).cast("int"))).alias("themes"),
        "polarity", "passage",
    )


def _overlap(x: str, values: list[str]) -> str:
    return f"list_has_any({x}, {sql_list(values)})"


def _sql_all_abstract(t: str) -> str:
    return f"(len(list_distinct({words(t)})) >= 3 and len(list_filter({words(t)}, lambda q: not list_contains({sql_list(vocab.ABSTRACT_TOKENS)}, q))) = 0)"


def _sql_ornamental(t: str) -> str:
    return f"(list_contains({sql_list(vocab.ORNAMENTAL_ENDINGS)}, string_split({t}, '_')[-1]) and not {_overlap(words(t), vocab.ANCHOR_TOKENS)})"


_GEO_MISMATCH = f"(len(list_filter({sql_list(vocab.TITLE_CITY_TOKENS)}, lambda w: contains(lower(book_title), w) and not contains(lower(place_name), w))) > 0)"
_LENS = f"len(list_filter({sql_list(vocab.CITY_LENS_PARTS)}, lambda w: contains(t, w))) > 0"
_GENRE_WORDS = "string_split(lower(array_to_string(genres, ' ')), ' ')"
_HUMOR = f"({_overlap(_GENRE_WORDS, vocab.HUMOR_WORDS)} or {has_any('lower(book_title)', vocab.HUMOR_WORDS)})"


@query(
    "j12_overrides",
    f"""with s0 as ({_STAGED}),
    s1 as (select * replace ({sql_clean_themes('themes')}[1:6] as themes) from s0),
    s2 as (select * replace (case when {has_any('lower(book_title)', vocab.ADVENTURE_TITLE_PARTS)} and not {_overlap('themes', vocab.ADVENTURE_THEMES)}
      then list_concat(['civilization_versus_wilderness', 'identity_reclamation'], themes)[1:6] else themes end as themes) from s1),
    s3 as (select * replace (case when {has_any('lower(book_title)', vocab.COLLECTED_TITLE_PARTS)} and not {_overlap('themes', vocab.COLLECTED_THEMES)}
      then list_concat(['gothic_psychology', 'analytic_detection'], themes)[1:6] else themes end as themes,
      case when {_HUMOR} and not {_overlap('emotions', vocab.PLAYFUL_EMOTIONS)} then list_concat(['mischief'], emotions)[1:5] else emotions end as emotions) from s2),
    s4 as (select * replace (case when {has_any('lower(place_name)', vocab.STEREOTYPED_CITIES)}
      then list_filter(themes, lambda t: not list_contains({sql_list(vocab.STEREOTYPE_THEMES)}, t)) else themes end as themes) from s3),
    s5 as (select * replace (case when {_GEO_MISMATCH} then list_filter(themes, lambda t: not ({_LENS})) else themes end as themes) from s4),
    s6 as (select * replace (case when book_title = 'Dubliners' then list_concat(['dublin_social_paralysis', 'epiphanic_stasis', 'irish_civic_stagnation'], themes)[1:6] else themes end as themes) from s5)
    select ord, array_to_string(list_filter(themes, lambda t: not ({_sql_all_abstract('t')} or {_sql_ornamental('t')})), '|') as themes,
     array_to_string(emotions, '|') as emotions from s6""",
)
def _(spark, d):
    return themes.with_overrides(_staged(spark, d)).select(
        "ord", joined("themes").alias("themes"), joined("emotions").alias("emotions")
    )


@query(
    "j13_haversine",
    """select ord, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))), 3) as metres,
     round(2 * 6371.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))), 6) as km
    from (select ord, power(sin(radians(19.076 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.076)) * power(sin(radians(72.8777 - lon) / 2), 2) as a from places)""",
)
def _(spark, d):
    bombay = (F.lit(72.8777), F.lit(19.076))
    return places(spark, d).select(
        "ord", F.round(geo.haversine("lon", "lat", *bombay), 3).alias("metres"),
        F.round(geo.haversine("lon", "lat", *bombay, geo.EARTH_KM), 6).alias("km"),
    )


_SPLIT = r"regexp_split_to_array({x}, '(?i)\s*(?:;|/|\||&|\band\b)\s*')"
_PARTS = _SPLIT.format(x="label")


@query(
    "j14_composite_parts",
    f"""with l as (select ord, place_name || case ord % 3 when 0 then ' / ' || region when 1 then '; ' || place_name else '' end as label from places)
    select ord, len(list_filter({_PARTS}, lambda p: trim(p) <> '')) > 1 as composite,
     array_to_string({sql_ordered_distinct(f"[trim(p, ' ,.-') for p in {_PARTS}]")}, '|') as parts from l""",
)
def _(spark, d):
    m = F.col("ord") % 3
    tail = F.when(m == 0, F.concat(F.lit(" / "), "region")).when(m == 1, F.concat(F.lit("; "), "place_name")).otherwise(F.lit(""))
    label = F.concat("place_name", tail)
    return places(spark, d).select(
        "ord", text.is_composite(label).alias("composite"), joined(text.composite_parts(label)).alias("parts")
    )


@query(
    "j16_presentation",
    """select ord, case when length(passage) > 300 then passage[1:300] || '...' else passage end as short,
     rtrim(translate(base64(encode(id)), '+/', '-_'), '=') as key,
     array_to_string([array_to_string([upper(w[1]) || w[2:] for w in string_split(t, '_')], ' ') for t in themes], '|') as labels from places""",
)
def _(spark, d):
    return places(spark, d).select(
        "ord", text.truncated("passage", 300, "...").alias("short"), text.url_key("id").alias("key"),
        joined(F.transform("themes", lambda t: text.theme_label(t))).alias("labels"),
    )


_ERA = """case when publish_year < 1900 then 'Pre-1900' when publish_year < 1950 then '1900–1950' when publish_year < 1980 then '1950–1980'
 when publish_year < 2000 then '1980–2000' else '2000–present' end"""


@query("j17_decade_era", f"select ord, (publish_year // 10 * 10) || 's' as decade, {_ERA} as era from places")
def _(spark, d):
    return places(spark, d).select("ord", text.decade("publish_year").alias("decade"), text.era_bucket("publish_year").alias("era"))


@query(
    "j18_links",
    """select ord, case when ord % 4 <> 0 then 'https://covers.openlibrary.org/b/id/' || (ord % 4) || '-M.jpg' end as cover,
     'https://openlibrary.org/works/OL' || ord || 'W' as work,
     case when ord % 4 <> 0 then 'https://www.wikidata.org/wiki/Q' || ord || '|' else '' end || 'https://openlibrary.org/works/OL' || ord || 'W' as same_as
    from places""",
)
def _(spark, d):
    n = F.col("ord").cast("string")
    key, qid = F.concat(F.lit("/works/OL"), n, F.lit("W")), F.when(F.col("ord") % 4 != 0, F.concat(F.lit("Q"), n))
    return places(spark, d).select(
        "ord", text.cover_url(F.col("ord") % 4).alias("cover"), text.work_url(key).alias("work"),
        joined(text.same_as(qid, F.lit(None).cast("string"), key)).alias("same_as"),
    )


# ---- C: derived columns ----

COMPOSITE_SQL = f"(len(list_filter({_SPLIT.format(x='place_name')}, lambda p: trim(p) <> '')) > 1)"
LABELLED_SQL = f"""select * replace (case ord % 7 when 0 then place_name || ' Province' when 1 then 'unknown village' when 2 then 'Roman Empire'
 when 3 then 'Seattle' when 4 then 'Texas' else place_name end as place_name) from places"""


def labelled(spark, d):
    """Place labels that reach every rule about labels."""
    m, name = F.col("ord") % 7, F.col("place_name")
    label = (
        F.when(m == 0, F.concat(name, F.lit(" Province"))).when(m == 1, F.lit("unknown village"))
        .when(m == 2, F.lit("Roman Empire")).when(m == 3, F.lit("Seattle")).when(m == 4, F.lit("Texas")).otherwise(name)
    )
    return places(spark, d).withColumn("place_name", label)


GRANULARITY_SQL = f"""case when {norm('place_name')} = '' or {norm('place_name')} in {sql_in(vocab.VAGUE_PLACES)}
 or regexp_matches({norm('place_name')}, '\\b(?:empire|continent|subcontinent|hemisphere)\\b') or {COMPOSITE_SQL} then 'region' else 'city' end"""


@query("c3_place_granularity", f"with l as ({LABELLED_SQL}) select ord, {GRANULARITY_SQL} as granularity from l")
def _(spark, d):
    return labelled(spark, d).select("ord", quality.place_granularity().alias("granularity"))


@query(
    "c4_geolocation_fields",
    f"""with l as ({LABELLED_SQL}), g as (select *, {GRANULARITY_SQL} as granularity from l)
    select ord, granularity as place_granularity, cast(case when granularity = 'city' then 15.0 else 120.0 end as double) as coordinate_precision_km,
     cast(case when ord % 2 = 0 then 0.5 when granularity = 'city' then 0.85 else 0.45 end as double) as coordinate_confidence,
     case when ord % 3 = 0 then 'wikidata' else 'dataset' end as coordinate_source, false as geolocation_needs_review from g""",
)
def _(spark, d):
    rows = labelled(spark, d).withColumns(
        {
            "coordinate_confidence": F.when(F.col("ord") % 2 == 0, F.lit(0.5)),
            "source": F.when(F.col("ord") % 3 == 0, F.lit(" Wikidata")),
        }
    )
    return quality.with_geolocation_fields(rows).select(
        "ord", "place_granularity", "coordinate_precision_km", "coordinate_confidence", "coordinate_source",
        "geolocation_needs_review",
    )


_SOURCED_SQL = f"""select *, case ord % 5 when 0 then 'openlibrary' when 1 then 'wikidata' when 2 then 'Wikipedia dump' when 3 then '' else author end as source from places"""


def _sourced(spark, d):
    m = F.col("ord") % 5
    source = (
        F.when(m == 0, F.lit("openlibrary")).when(m == 1, F.lit("wikidata")).when(m == 2, F.lit("Wikipedia dump"))
        .when(m == 3, F.lit("")).otherwise(F.col("author"))
    )
    return places(spark, d).withColumn("source", source)


SOURCE_CASE = """case when contains(lower(source), 'openlibrary') then 'openlibrary' when lower(source) = 'wikidata' then 'wikidata'
 when contains(lower(source), 'wiki') then 'wikipedia' when source = '' then 'unknown' else lower(source) end"""
_P = strip("passage")
TYPE_CASE = f"""case when length({_P}) = 0 then 'none' when length({_P}) < 60 then 'short_stub'
 when ps = 'wikidata' and length({_P}) < 320 then 'wikidata_stub' when ps = 'openlibrary' then 'ol_description' when ps = 'wikipedia' then 'wikipedia_summary'
 when length({_P}) >= 400 and (length({_P}) - length(replace({_P}, '"', '')) >= 2 or contains({_P}, ''''))
  and not regexp_matches(lower({_P}), '^(?:this|a|an|the) ') then 'literary_excerpt' else 'other' end"""


@query("c5_passage_source", f"with s as ({_SOURCED_SQL}) select ord, {SOURCE_CASE} as passage_source from s")
def _(spark, d):
    return _sourced(spark, d).select("ord", quality.passage_source("source", F.lit(None).cast("string")).alias("passage_source"))


@query("c6_passage_type", f"with s as (select *, {SOURCE_CASE} as ps from ({_SOURCED_SQL})) select ord, {TYPE_CASE} as passage_type from s")
def _(spark, d):
    rows = _sourced(spark, d).withColumn("passage_source", quality.passage_source("source", F.lit(None).cast("string")))
    return rows.select("ord", quality.passage_type().alias("passage_type"))


@query(
    "c7_enrichment_method",
    f"""select ord, case when len(themes) = 0 and len(emotions) = 0 then 'none' when {_P} <> '' then 'gemini_passage' else 'gemini_reputation' end as method
    from places""",
)
def _(spark, d):
    return places(spark, d).select("ord", quality.enrichment_method().alias("method"))


def _few(c: str) -> str:
    return f"length(split_part(cast(abs({c}) as varchar), '.', 2)) <= 1"


RISK_SQL = {
    "composite_place_label": (COMPOSITE_SQL, 0.45),
    "broad_or_region_place": (f"(granularity = 'region' or {has_any('lower(place_name)', vocab.BROAD_PLACE_HINTS)})", 0.30),
    "uncertain_place_label": (has_any("lower(place_name)", vocab.UNCERTAIN_LABEL_HINTS), 0.35),
    "coarse_coordinate_precision": (f"({_few('lon')} or {_few('lat')})", 0.15),
    "low_coordinate_confidence": ("(confidence <= 0.35)", 0.25),
    "low_spatial_precision": ("(precision_km >= 100)", 0.20),
}
_FLAGS = ", ".join(f"case when {c} then '{n}' end" for n, (c, _) in RISK_SQL.items())
_SCORE = "1.0::double" + "".join(f" - case when list_contains(flags, '{n}') then {p}::double else 0.0::double end" for n, (_, p) in RISK_SQL.items())
STRICT_SQL = f"""case when length({_P}) >= 150 and passage_type not in ('none', 'short_stub', 'wikidata_stub') and len(themes) >= 3 and len(emotions) >= 2 and polarity <> 0 then 'gold'
 when {strip('book_title')} <> '' and {strip('author')} <> '' and publish_year > 0 and granularity <> 'region' then 'silver' else 'stub' end"""
# places with provenance and geolocation fields, and the verdict of the gate, as CTEs
PREPARED_SQL = f"""l as ({LABELLED_SQL}),
 g as (select *, {GRANULARITY_SQL} as granularity, 'unknown' as ps from l),
 prepared as (select *, {TYPE_CASE} as passage_type, case when ord % 10 = 0 then 0.2 when granularity = 'city' then 0.85 else 0.45 end as confidence,
  case when granularity = 'city' then 15.0 else 120.0 end as precision_km from g)"""
GATED_SQL = f"""{PREPARED_SQL},
 flagged as (select *, list_filter([{_FLAGS}], lambda f: f is not null) as flags, {STRICT_SQL} as tier from prepared),
 scored as (select *, greatest(0.0, {_SCORE}) as geo_quality from flagged),
 gated as (select *, round(case tier when 'gold' then 1.0::double when 'silver' then 0.75::double else 0.35::double end * 0.7::double + geo_quality * 0.3::double, 3) as quality_score from scored)"""
PASSED_SQL = "(quality_score >= 0.55 and geo_quality >= 0.6 and not list_contains(flags, 'composite_place_label'))"


def prepared(spark, d):
    """Rows as they reach the gate: provenance and geolocation fields, some with poor confidence."""
    rows = labelled(spark, d).withColumn("coordinate_confidence", F.when(F.col("ord") % 10 == 0, F.lit(0.2)))
    rows = quality.with_geolocation_fields(rows).withColumn("passage_source", F.lit("unknown"))
    return rows.withColumn("passage_type", quality.passage_type())


def gated(spark, d):
    return quality.quality_gate(prepared(spark, d))


@query(
    "c8_geo_quality",
    f"with {GATED_SQL} select ord, round(geo_quality, 6) as geo_quality, array_to_string(flags, '|') as flags from gated",
)
def _(spark, d):
    return quality.with_geo_quality(prepared(spark, d)).select(
        "ord", F.round("geo_quality", 6).alias("geo_quality"), joined("geo_risk_flags").alias("flags")
    )


@query("c9_tier_strict", f"with {GATED_SQL} select ord, tier from gated")
def _(spark, d):
    return prepared(spark, d).select("ord", quality.tier_strict().alias("tier"))


@query(
    "c10_tier_lenient",
    f"""with {PREPARED_SQL} select ord, case when ord % 9 = 0 then 'gold' when {_P} <> '' and len(themes) > 0 and granularity <> 'region' then 'gold'
    when {_P} <> '' or len(themes) > 0 then 'silver' else 'stub' end as tier from prepared""",
)
def _(spark, d):
    given = F.when(F.col("ord") % 9 == 0, F.lit("Gold")).when(F.col("ord") % 9 == 1, F.lit("best"))
    return prepared(spark, d).withColumn("quality_tier", given).select("ord", quality.tier_lenient().alias("tier"))


@query("c11_quality_gate", f"with {GATED_SQL} select ord, tier, quality_score, {PASSED_SQL} as passed from gated")
def _(spark, d):
    return gated(spark, d).select("ord", F.col("quality_tier").alias("tier"), "quality_score", F.col("quality_passed").alias("passed"))


@query(
    "c12_read_links",
    """select ord, case when ord % 2 = 0 then 'https://openlibrary.org/works/OL' || ord || 'W' end as url,
     case when ord % 2 = 1 then 'https://www.google.com/search?q=' || replace(book_title || ' ' || author, ' ', '+') || '+book' end as link from places""",
)
def _(spark, d):
    key = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("/works/OL"), F.col("ord").cast("string"), F.lit("W")))
    return with_read_links(places(spark, d).withColumn("open_library_key", key)).select(
        "ord", F.col("open_library_url").alias("url"), F.col("goodreads_url").alias("link")
    )


@query(
    "c13_sentiment_bucket",
    """select ord, case when p >= 0.2 then 'positive' when p <= -0.2 then 'negative' else 'neutral' end as inclusive,
     case when p > 0.2 then 'positive' when p < -0.2 then 'negative' else 'neutral' end as strict from (select ord, polarity * 0.4 as p from places)""",
)
def _(spark, d):
    p = F.col("polarity") * 0.4
    return places(spark, d).select(
        "ord", quality.sentiment_bucket(p, True).alias("inclusive"), quality.sentiment_bucket(p, False).alias("strict")
    )


@query(
    "c15_book_composite_text",
    """with b as (select book_title, author, arg_min(genres, ord) as genres, arg_min(case when passage <> '' then passage end, case when passage <> '' then ord end) as passage,
      list_sort(list_distinct(list(place_name))) as cities, list_sort(list_distinct(flatten(list(themes)))) as themes, list_sort(list_distinct(flatten(list(emotions)))) as emotions
     from places group by book_title, author)
    select book_title, author, 'Title: ' || book_title || '. Author: ' || author || '. Genres: ' || array_to_string(genres, ' ') || '. Set in: ' || array_to_string(cities, ' ')
     || '. Themes: ' || array_to_string(themes[1:5], ' ') || '. Emotions: ' || array_to_string(emotions[1:5], ' ') || '. Context: ' || coalesce(passage, '')[1:200] as composite_text from b""",
)
def _(spark, d):
    return book_composite_text(books_from_entries(places(spark, d))).select("book_title", "author", "composite_text")

