"""Predicates, search, facets and paging over the place view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions import geo, themes, titles
from tomeatlas.operators import fuzzy, search
from tomeatlas.operators.dedup import split_by
from tomeatlas.operators.profiles import value_counts
from tomeatlas.streaming.intake import validate_contribution
from workload.expressions import (
    _GENRE_WORDS,
    _GEO_MISMATCH,
    _HUMOR,
    _LENS,
    _overlap,
    _sql_all_abstract,
    _sql_ornamental,
    _staged,
    _STAGED,
    GATED_SQL,
    gated,
    sql_clean_themes,
)
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
    table,
    words,
)

_HAYSTACK = "lower(concat_ws(' ', book_title, author, place_name, array_to_string(genres, ' '), array_to_string(themes, ' '), passage))"


@query("f1_search_all_terms", f"select ord, id, book_title from places where contains({_HAYSTACK}, 'nation_1') and contains({_HAYSTACK}, 'war')")
def _(spark, d):
    return search.search_all_terms(places(spark, d), "NATION_1 war").select("ord", "id", "book_title")


@query(
    "f2_search_contains",
    """select ord, id from places where contains(lower(book_title), 'war tr') or contains(lower(author), 'war tr') or contains(lower(place_name), 'war tr')
    or contains(lower(passage), 'war tr') or len(list_filter(themes, lambda t: contains(replace(t, '_', ' '), 'war tr'))) > 0
    or len(list_filter(emotions, lambda t: contains(replace(t, '_', ' '), 'war tr'))) > 0""",
)
def _(spark, d):
    return search.search_contains(places(spark, d), "War tr").select("ord", "id")


@query(
    "f3_filter_places",
    """select ord, id from places where lower(region) = (select lower(r_name) from region where r_regionkey = 1) and contains(lower(author), 'src1')
    and contains(lower(place_name), 'nation_1') and len(list_filter(genres, lambda g: contains(lower(g), 'fiction'))) > 0""",
)
def _(spark, d):
    name = table(spark, d, "region").filter("r_regionkey = 1").first()["r_name"]
    return search.filter_places(places(spark, d), region=name.upper(), author="SRC1", city="nation_1", genre="Fiction").select("ord", "id")


@query("f4_filter_years", "select ord, publish_year from places where publish_year between 1900 and 1950")
def _(spark, d):
    return search.filter_years(places(spark, d), 1900, 1950).select("ord", "publish_year")


@query(
    "f5_filter_facets",
    """select ord, id from places where region in (select r_name from region where r_regionkey < 3) and list_has_any(genres, ['crime', 'poetry'])
    and language in ('en', 'fr') and (publish_year < 1900 or publish_year >= 2000)""",
)
def _(spark, d):
    regions = [r["r_name"] for r in table(spark, d, "region").filter("r_regionkey < 3").collect()]
    return search.filter_facets(
        places(spark, d), regions, ["crime", "poetry"], ["en", "fr"], ["Pre-1900", "2000–present"]
    ).select("ord", "id")


def _sql_theme_has(part: str) -> str:
    return f"len(list_filter(themes, lambda t: contains(t, '{part}'))) > 0"


_LISTS = {
    "partition-fiction": f"{_sql_theme_has('partition')} or {has_any('lower(book_title)', ['partition', 'train to pakistan', 'tamas', 'ice-candy-man'])}",
    "mumbai-noir": f"place_name = 'Mumbai' and (list_has_any(genres, ['crime', 'mystery', 'thriller']) or {_sql_theme_has('corruption')})",
    "translation": "language not in ('English', 'Unknown', '')",
    "historical-fiction": "list_contains(genres, 'historical fiction')",
    "small-towns": f"region = 'South Asia' and place_name not in {sql_in(vocab.METROS)}",
}
_RELABELLED_SQL = """select * replace (case when ord % 5 = 0 then 'Mumbai' else place_name end as place_name, case when ord % 4 = 0 then 'South Asia' else region end as region,
 case when ord % 6 = 0 then 'English' else language end as language, case when ord % 8 = 0 then list_concat(themes, ['partition_memory']) else themes end as themes) from places"""


def _relabelled(spark, d):
    o = F.col("ord")
    return places(spark, d).withColumns(
        {
            "place_name": F.when(o % 5 == 0, F.lit("Mumbai")).otherwise(F.col("place_name")),
            "region": F.when(o % 4 == 0, F.lit("South Asia")).otherwise(F.col("region")),
            "language": F.when(o % 6 == 0, F.lit("English")).otherwise(F.col("language")),
            "themes": F.when(o % 8 == 0, F.concat("themes", F.array(F.lit("partition_memory")))).otherwise(F.col("themes")),
        }
    )


@query(
    "f6_reading_list_counts",
    f"with p as ({_RELABELLED_SQL}) " + " union all ".join(f"select '{n}' as list, count(*) filter (where {c}) as entries from p" for n, c in _LISTS.items()),
)
def _(spark, d):
    return search.reading_list_counts(_relabelled(spark, d))


@query("f6_reading_list", f"with p as ({_RELABELLED_SQL}) select ord, id from p where {_LISTS['mumbai-noir']}")
def _(spark, d):
    return search.reading_list(_relabelled(spark, d), "mumbai-noir").select("ord", "id")


@query(
    "f7_map_visible",
    f"with {GATED_SQL}, v as (select * from gated where granularity <> 'region') select ord, tier from v where tier <> 'stub' or not exists (select 1 from v where tier <> 'stub')",
)
def _(spark, d):
    return search.map_visible(gated(spark, d)).select("ord", F.col("quality_tier").alias("tier"))


_TITLED_SQL = f"""select ord, case ord % 12 when 0 then 'A Dictionary of ' || author when 1 then 'a dictionary of  maqiao' when 2 then 'Field Guide to ' || author
 when 3 then 'Q' || ord when 4 then 'Poems' when 5 then 'Dubliners' when 6 then 'Report on the ' || author when 7 then 'Autobiography of ' || author
 when 8 then 'Bombay Stories' when 9 then 'Digital Fortress' when 10 then 'ab' else book_title end as book_title,
 case ord % 5 when 0 then 'Dublin' when 1 then 'Mumbai' else place_name end as place_name,
 case ord % 6 when 0 then ['memoir'] when 1 then ['biography', 'essay'] when 2 then ['social realism'] else genres end as genres,
 case when ord % 7 = 0 then 'This book examines ' || passage else passage end as passage, author, region from places"""


def _titled(spark, d):
    o, a = F.col("ord"), F.col("author")
    choices = {
        0: F.concat(F.lit("A Dictionary of "), a), 1: F.lit("a dictionary of  maqiao"), 2: F.concat(F.lit("Field Guide to "), a),
        3: F.concat(F.lit("Q"), o.cast("string")), 4: F.lit("Poems"), 5: F.lit("Dubliners"), 6: F.concat(F.lit("Report on the "), a),
        7: F.concat(F.lit("Autobiography of "), a), 8: F.lit("Bombay Stories"), 9: F.lit("Digital Fortress"), 10: F.lit("ab"),
    }
    title = F.col("book_title")
    for n, c in choices.items():
        title = F.when(o % 12 == n, c).otherwise(title)
    factual = {0: ["memoir"], 1: ["biography", "essay"], 2: ["social realism"]}
    genres = F.col("genres")
    for n, g in factual.items():
        genres = F.when(o % 6 == n, F.array(*[F.lit(x) for x in g])).otherwise(genres)
    return places(spark, d).select(
        "ord", title.alias("book_title"),
        F.when(o % 5 == 0, F.lit("Dublin")).when(o % 5 == 1, F.lit("Mumbai")).otherwise(F.col("place_name")).alias("place_name"),
        genres.alias("genres"),
        F.when(o % 7 == 0, F.concat(F.lit("This book examines "), "passage")).otherwise(F.col("passage")).alias("passage"),
        "author", "region",
    )


_T = norm("book_title")
_ALTERNATIVES = "\\b(?:" + "|".join(vocab.NONFICTION_TITLE_WORDS) + ")\\b"
NONFICTION_SQL = f"({_T} not in {sql_in(vocab.NONFICTION_SAFELIST)} and regexp_matches({_T}, '{_ALTERNATIVES}'))"


@query("f8_nonfiction_title", f"with t as ({_TITLED_SQL}) select ord, {NONFICTION_SQL} as hit from t")
def _(spark, d):
    return _titled(spark, d).select("ord", titles.is_nonfiction_title().alias("hit"))


def _esc(s: str) -> str:
    return s.replace("'", "''")


_REASONS = " ".join(
    [f"when regexp_matches(lower(book_title), '{_esc(w)}') then 'title matches: {_esc(w)}'" for w in vocab.REPORT_TITLE_WORDS]
    + [f"when regexp_matches(lower(passage), '{_esc(w)}') then 'description matches: {_esc(w)}'" for w in vocab.REPORT_TEXT_PATTERNS]
)
_SETTLED = [g for g in vocab.FICTION_GENRES if g != "literary fiction"]
_FACTUAL = "len(genres) > 0 and len(list_filter(genres, lambda g: g not in ('biography', 'memoir', 'social realism', 'essay'))) = 0"


@query(
    "f9_nonfiction_reason",
    f"""with t as ({_TITLED_SQL}) select ord, case when lower(book_title) in {sql_in(vocab.KEPT_TITLES)} or lower(author) in {sql_in(vocab.KEPT_AUTHORS)}
     or list_has_any(genres, {sql_list(_SETTLED)}) then null {_REASONS}
     when {_FACTUAL} and list_contains(genres, 'biography') then 'pure biography'
     when genres = ['social realism'] then 'pure social realism (likely nonfiction)' when genres = ['memoir'] then 'pure memoir'
     when genres = ['essay'] then 'pure essay/nonfiction' when contains(lower(book_title), 'autobiography') then 'autobiography in title' end as reason from t""",
)
def _(spark, d):
    return _titled(spark, d).select("ord", titles.nonfiction_reason().alias("reason"))


@query(
    "f10_likely_fiction",
    f"""with b as (select p_partkey, case p_partkey % 6 when 0 then 'Study Guide to ' || p_name when 1 then '' else p_name end as title,
      case when p_partkey % 7 = 0 then 'SparkNotes' else p_brand end as author,
      [lower(p_type), case p_partkey % 4 when 0 then 'World history' when 1 then 'historical fiction' when 2 then 'Dictionaries' else 'bolts' end] as subjects from part)
    select p_partkey, title <> '' and not {has_any('lower(title)', vocab.BLOCKED_TITLE_PARTS)} and not {has_any('lower(author)', vocab.BLOCKED_AUTHOR_PARTS)}
     and not ({has_any("lower(array_to_string(subjects, ' '))", vocab.REFERENCE_SUBJECT_PARTS)} and not {has_any("lower(array_to_string(subjects, ' '))", vocab.FICTION_SUBJECT_PARTS)}) as fiction from b""",
)
def _(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "World history").when(k % 4 == 1, "historical fiction").when(k % 4 == 2, "Dictionaries").otherwise("bolts")
    books = table(spark, d, "part").select(
        k,
        F.when(k % 6 == 0, F.concat(F.lit("Study Guide to "), "p_name")).when(k % 6 == 1, F.lit("")).otherwise(F.col("p_name")).alias("title"),
        F.array(F.when(k % 7 == 0, F.lit("SparkNotes")).otherwise(F.col("p_brand"))).alias("authors"),
        F.array(F.lower("p_type"), kind).alias("subjects"),
    )
    return books.select("p_partkey", titles.is_likely_fiction().alias("fiction"))


@query("f11_suspected_nonfiction", f"with t as ({_TITLED_SQL}) select ord, {has_any('lower(book_title)', vocab.SUSPECT_TITLE_PARTS)} as hit from t")
def _(spark, d):
    return _titled(spark, d).select("ord", titles.suspected_nonfiction().alias("hit"))


AMBIGUOUS_SQL = f"(length({_T}) <= 2 or regexp_matches({_T}, '^q\\d+$') or {_T} in {sql_in(vocab.GENERIC_TITLES)})"


@query("f12_ambiguous_title", f"with t as ({_TITLED_SQL}) select ord, {AMBIGUOUS_SQL} as hit from t")
def _(spark, d):
    return _titled(spark, d).select("ord", titles.is_ambiguous_title().alias("hit"))


_CITY_PAIRS = [*vocab.TITLE_CITY_ALIASES.items(), *vocab.CITY_DEMONYMS.items()]
_MENTIONED = "list_distinct([x.v for x in [" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in _CITY_PAIRS) + f"] if contains({_T}, x.k)])"
_CANONICAL = f"coalesce({sql_map(vocab.TITLE_CITY_ALIASES)}[{norm('place_name')}], {norm('place_name')})"
MISMATCH_SQL = f"(len({_MENTIONED}) = 1 and {_MENTIONED}[1] <> {_CANONICAL})"


@query("f13_title_city_mismatch", f"with t as ({_TITLED_SQL}) select ord, {MISMATCH_SQL} as hit from t")
def _(spark, d):
    return _titled(spark, d).select("ord", titles.is_title_city_mismatch().alias("hit"))


@query("f14_title_geo_mismatch", f"with t as ({_STAGED}) select ord, {_GEO_MISMATCH} as hit from t")
def _(spark, d):
    return _staged(spark, d).select("ord", titles.title_geo_mismatch().alias("hit"))


@query(
    "f15_needs_enrichment",
    f"""with t as (select * replace (case when ord % 9 = 0 then ' Q' || ord else book_title end as book_title) from places)
    select ord, case when regexp_matches(trim(book_title), '^Q\\d+$') then false when {strip('passage')} = '' then polarity = 0
     else len(emotions) = 0 or len(themes) < 2 or polarity = 0 end as needed from t""",
)
def _(spark, d):
    title = F.when(F.col("ord") % 9 == 0, F.concat(F.lit(" Q"), F.col("ord").cast("string"))).otherwise(F.col("book_title"))
    return places(spark, d).withColumn("book_title", title).select("ord", themes.needs_enrichment().alias("needed"))


_FILLED_SQL = "select ord, list_concat(themes, ['Social Constraint', 'cultural_tension', 'memory_of_place'][1:cast(ord % 4 as int)]) as themes from places"


@query(
    "f16_filler",
    f"with t as ({_FILLED_SQL}) select ord, len(list_filter({sql_clean_themes('themes')}[1:6], lambda t: list_contains({sql_list(vocab.FILLER_THEMES)}, t))) >= 2 as filler from t",
)
def _(spark, d):
    extra = F.array(*[F.lit(x) for x in ("Social Constraint", "cultural_tension", "memory_of_place")])
    filled = F.concat("themes", F.slice(extra, F.lit(1), (F.col("ord") % 4).cast("int")))
    return places(spark, d).select("ord", themes.is_filler(filled).alias("filler"))


_ANCHORED = f"len(list_filter(themes, lambda t: {_overlap(words('t'), vocab.ANCHOR_TOKENS)})) > 0"
_ABSTRACTED = f"len(list_filter(themes, lambda t: {_overlap(words('t'), vocab.ABSTRACTION_TOKENS)})) > 0"
_GROUNDED = f"({_ANCHORED} and {_ABSTRACTED} and len(list_filter(themes, lambda t: {_sql_ornamental('t')} or {_sql_all_abstract('t')})) = 0)"
_LINES = f"""list_concat([case when not ({_ANCHORED}) then 'missing concrete anchor (institution/system/event/place-role)' end,
 case when not ({_ABSTRACTED}) then 'missing thematic abstraction (oppression/displacement/conflict/etc.)' end],
 flatten([[case when {_sql_all_abstract('t')} then 'overly abstract construction: ' || t end, case when {_sql_ornamental('t')} then 'ornamental constructed suffix: ' || t end] for t in themes]))"""


@query(
    "f17_grounding",
    f"""with t as ({_STAGED}), l as (select *, list_filter({_LINES}, lambda x: x is not null) as lines from t)
    select ord, {_GROUNDED} as grounded, coalesce(nullif(array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), '; '), ''), 'theme set failed quality heuristics') as feedback from l""",
)
def _(spark, d):
    return _staged(spark, d).select("ord", themes.grounding_ok().alias("grounded"), themes.theme_feedback().alias("feedback"))


def _count(values: list[str]) -> str:
    return f"len(list_filter(t6, lambda t: list_contains({sql_list(values)}, t)))"


@query(
    "f17_looks_generic",
    f"""with t as (select *, {sql_clean_themes('themes')}[1:6] as t6, emotions[1:5] as e5 from ({_STAGED})),
    c as (select *, {_GROUNDED.replace('themes', 't6')} as grounded from t)
    select ord, len(e5) < 3 or len(t6) < 4 or not grounded
     or (book_title = 'Dubliners' and not list_has_any(t6, ['dublin_social_paralysis', 'epiphanic_stasis', 'irish_civic_stagnation']))
     or {_count(vocab.GENERIC_THEMES)} >= 2 or ({has_any('lower(place_name)', vocab.STEREOTYPED_CITIES)} and {_count(vocab.STEREOTYPE_THEMES)} >= 2)
     or ({_GEO_MISMATCH} and len(list_filter(t6, lambda t: {_LENS})) > 0) or ({_HUMOR} and not {_overlap('e5', vocab.PLAYFUL_EMOTIONS)})
     or (({_overlap(_GENRE_WORDS, vocab.CHILDREN_WORDS)} or contains(lower(book_title), 'madeline')) and len(list_filter(e5, lambda e: not list_contains({sql_list(vocab.DARK_EMOTIONS)}, e))) = 0)
     or ({has_any('lower(book_title)', vocab.ADVENTURE_TITLE_PARTS)} and not {_overlap('t6', vocab.ADVENTURE_THEMES)})
     or ({has_any('lower(book_title)', vocab.COLLECTED_TITLE_PARTS)} and not {_overlap('t6', vocab.COLLECTED_THEMES)}) as looks_generic from c""",
)
def _(spark, d):
    return themes.with_generic_flag(_staged(spark, d)).select("ord", "looks_generic")


# every rule of the output check is broken by some rows
_RESULT_PARTS = """select ord, case when ord % 11 = 0 then 1.5::double else polarity end as polarity, emotions as dominant_emotions,
 list_concat(themes, ['war_trauma', 'labor_exploitation', 'village_memory'][1:cast(ord % 4 as int)]) as themes,
 case when ord % 13 = 0 then 'Dark Mood' else 'quiet_dread' end as literary_mood from places"""


def result_json(spark, d):
    """Enrichment results as JSON text, some malformed, incomplete or out of bounds."""
    o = F.col("ord")
    extra = F.array(*[F.lit(x) for x in ("war_trauma", "labor_exploitation", "village_memory")])
    parts = F.struct(
        F.when(o % 11 == 0, F.lit(1.5)).otherwise(F.col("polarity")).alias("polarity"),
        F.col("emotions").alias("dominant_emotions"),
        F.concat("themes", F.slice(extra, F.lit(1), (o % 4).cast("int"))).alias("themes"),
        F.when(o % 13 == 0, F.lit("Dark Mood")).otherwise(F.lit("quiet_dread")).alias("literary_mood"),
    )
    short = F.struct(parts["polarity"].alias("polarity"), parts["themes"].alias("themes"))
    text = (
        F.when(o % 17 == 0, F.lit('{"polarity": 0.1, "themes": ['))
        .when(o % 19 == 0, F.lit("[1, 2]"))
        .when(o % 23 == 0, F.to_json(short))
        .otherwise(F.to_json(parts))
    )
    return places(spark, d).select("ord", text.alias("result"))


def _sql_validity(anchors, abstractions, middle):
    return f"""case when ord % 17 = 0 then 'exception: malformed json' when ord % 19 = 0 then 'not an object' when ord % 23 = 0 then 'missing key: dominant_emotions'
     when polarity not between -1 and 1 then 'polarity out of range' {middle}
     when len(list_filter(themes, lambda t: {_overlap(words('t'), anchors)})) = 0 then 'missing concrete anchor theme'
     when len(list_filter(themes, lambda t: {_overlap(words('t'), abstractions)})) = 0 then 'missing abstraction theme' else 'ok' end"""


_STRICT_MIDDLE = """when len(dominant_emotions) not between 3 and 5 then 'dominant_emotions size invalid' when len(themes) not between 4 and 6 then 'themes size invalid'
 when len(list_filter(themes, lambda t: not regexp_full_match(t, '[a-z0-9]+(?:_[a-z0-9]+)+'))) > 0 then 'themes format invalid'
 when not regexp_full_match(literary_mood, '[a-z_]+') then 'literary_mood format invalid'"""


@query(
    "f18_validate_enrichment",
    f"""with r as ({_RESULT_PARTS}) select ord, {_sql_validity(vocab.STRICT_ANCHORS, vocab.STRICT_ABSTRACTIONS, _STRICT_MIDDLE)} as strict,
    {_sql_validity(vocab.RELAXED_ANCHORS, vocab.RELAXED_ABSTRACTIONS, "when len(themes) < 3 then 'themes too few'")} as relaxed from r""",
)
def _(spark, d):
    return result_json(spark, d).select(
        "ord", themes.validation_reason("result", "strict").alias("strict"), themes.validation_reason("result", "relaxed").alias("relaxed")
    )


_SHIFTED_SQL = """select ord, case when ord % 10 = 0 then null when ord % 7 = 0 then lon + 400 when ord % 6 = 0 then 0.005::double else lon end as lon,
 case when ord % 6 = 0 then -0.009::double else lat end as lat from places"""


def _shifted(spark, d):
    o = F.col("ord")
    lon = F.when(o % 10 == 0, F.lit(None).cast("double")).when(o % 7 == 0, F.col("lon") + 400).when(o % 6 == 0, F.lit(0.005)).otherwise(F.col("lon"))
    return places(spark, d).withColumns({"lon": lon, "lat": F.when(o % 6 == 0, F.lit(-0.009)).otherwise(F.col("lat"))})


@query(
    "f19_coord_status",
    f"""with s as ({_SHIFTED_SQL}) select ord, case when lon is null or lat is null then 'missing' when not (lon between -180 and 180 and lat between -90 and 90) then 'out_of_range'
     when abs(lon) < 0.01 and abs(lat) < 0.01 then 'null_island' else 'ok' end as status from s""",
)
def _(spark, d):
    return _shifted(spark, d).select("ord", geo.coord_status().alias("status"))


def contributions(spark, d):
    o = F.col("ord")
    point = F.when(o % 10 == 0, F.array("lon")).when(o % 7 == 0, F.array(F.col("lon") + 400, F.col("lat"))).otherwise(F.array("lon", "lat"))
    return places(spark, d).select(
        "ord", F.when(o % 12 == 0, F.lit(" ")).otherwise(F.col("book_title")).alias("book_title"), "author", "publish_year", "place_name",
        point.alias("coordinates"), "passage", F.when(o % 14 != 0, F.col("themes")).alias("themes"),
        F.when(o % 2 == 0, F.col("language")).alias("language"),
    )


@query(
    "f20_validate_contribution",
    f"""with c as (select ord, case when ord % 12 = 0 or {strip('book_title')} = '' then 'missing book_title' when {strip('passage')} = '' then 'missing passage' when ord % 14 = 0 then 'missing themes'
      when ord % 10 = 0 then 'coordinates must be [longitude, latitude]' when ord % 7 = 0 and lon + 400 > 180 then 'coordinates out of range' end as fault,
      case when ord % 2 = 0 then language else 'English' end as language from places)
    select ord, fault, language, case when fault is null then 'pending' else 'rejected' end as status from c""",
)
def _(spark, d):
    return validate_contribution(contributions(spark, d)).select("ord", "fault", "language", "status")


@query("f21_get_place", "select ord, id, book_title, place_name from places where id = 'doc-42' order by ord limit 1")
def _(spark, d):
    return search.get_place(places(spark, d), "doc-42").select("ord", "id", "book_title", "place_name")


_PATHS_SQL = "select c_custkey, r_name || '.' || n_name || '.c' || c_custkey as path from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"


@query(
    "f22_geo_path",
    f"""with p as ({_PATHS_SQL}), r0 as (select r_name from region where r_regionkey = 0), r1 as (select r_name from region where r_regionkey = 1)
    select c_custkey, path = (from r0) or starts_with(path, (from r0) || '.') as below,
     regexp_matches(path, '^' || (from r1) || '\\.(?:NATION_1|NATION_6|NATION_11)(?:\\.[^.]+)*$') as matches from p""",
)
def _(spark, d):
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, d, "region").collect()}
    path = F.concat_ws(".", "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    joined_rows = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", path.alias("path"))
    )
    return joined_rows.select(
        "c_custkey", search.under_path("path", names[0]).alias("below"),
        search.path_matches("path", names[1], ["NATION_1", "NATION_6", "NATION_11"], None).alias("matches"),
    )


LEDGER_SQL = """select ord as sample_id, id, book_title as work_title, author, list_sort(list_distinct(list_concat([place_name], genres))) as places_named, place_name as primary_place,
 ['narrative', 'fictional', 'unknown', 'narrative', 'nonfiction'][cast(ord % 5 as int) + 1] as record_type, passage as notes,
 case when ord % 3 = 0 then 'open' else 'reviewed' end as status, ['gold', 'silver', 'stub', 'unknown'][cast(ord % 4 as int) + 1] as system_tier from places"""


def ledger(spark, d):
    o = F.col("ord")

    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (o % n).cast("int") + 1)

    return places(spark, d).select(
        o.alias("sample_id"), "id", F.col("book_title").alias("work_title"), "author",
        F.array_sort(F.array_distinct(F.concat(F.array("place_name"), "genres"))).alias("places"),
        F.col("place_name").alias("primary_place"),
        pick(["narrative", "fictional", "unknown", "narrative", "nonfiction"], 5).alias("record_type"), F.col("passage").alias("notes"),
        F.when(o % 3 == 0, F.lit("open")).otherwise(F.lit("reviewed")).alias("status"),
        pick(["gold", "silver", "stub", "unknown"], 4).alias("system_tier"),
    )


@query(
    "f23_ledger_search",
    f"""with g as ({LEDGER_SQL}) select sample_id, id from g where contains(lower(concat_ws(' ', id, work_title, author, primary_place, record_type, notes, array_to_string(places_named, ' '))), 'crime')""",
)
def _(spark, d):
    fields = ["id", "work_title", "author", "primary_place", "record_type", "notes"]
    return search.ledger_search(ledger(spark, d), " Crime", fields, ["places"]).select("sample_id", "id")


@query(
    "f24_backfill_candidates",
    f"""select ord, 'description' as kind from places where {strip('passage')} = '' union all select ord, 'summary' from places where {strip('passage')} = '' and ord % 2 = 0
    union all select ord, 'genres' from places where ord % 3 = 0 and len(genres) < 2""",
)
def _(spark, d):
    n = F.col("ord").cast("string")
    rows = places(spark, d).withColumns(
        {
            "wikidata_book_qid": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Q"), n)),
            "open_library_key": F.when(F.col("ord") % 3 == 0, F.concat(F.lit("/works/OL"), n)),
        }
    )
    parts = [
        search.backfill_candidates(rows, kind, min_genres=2).select("ord", F.lit(kind).alias("kind"))
        for kind in ("description", "summary", "genres")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- H, I ----


@query("h1_page", "select ord, id from places order by ord limit 20 offset 40")
def _(spark, d):
    return search.page(places(spark, d), 40, 20).select("ord", "id")


@query(
    "h2_order_results",
    f"""with {GATED_SQL} select ord, tier, publish_year from gated
    order by case tier when 'gold' then 0 when 'silver' then 1 else 2 end, publish_year desc, ord""",
)
def _(spark, d):
    return search.order_results(gated(spark, d)).select("ord", F.col("quality_tier").alias("tier"), "publish_year")


@query("h4_top_n", "select region as value, count(*) as entries from places group by 1 order by entries desc, value limit 3")
def _(spark, d):
    return search.top_n(value_counts(places(spark, d), "region"), 3)


@query(
    "i1_union_entries",
    "select ord, id, author, null as region from places union all select ord, 'again-' || id, null, region from places",
)
def _(spark, d):
    from tomeatlas.operators.dedup import union_entries

    p = places(spark, d)
    again = p.select("ord", F.concat(F.lit("again-"), "id").alias("id"), "region")
    return union_entries(p.select("ord", "id", "author"), again)


@query("i2_split_by", "select ord, polarity > 0 as removed from places")
def _(spark, d):
    kept, removed = split_by(places(spark, d), F.nullif("polarity", F.lit(0.0)) > 0)
    return kept.select("ord", F.lit(False).alias("removed")).unionByName(removed.select("ord", F.lit(True).alias("removed")))


@query(
    "i3_array_sets",
    """select ord, array_to_string(list_sort(list_distinct(list_concat(genres, themes))), '|') as all_labels,
     array_to_string(list_sort(list_intersect(genres, ['crime', 'poetry', 'satire'])), '|') as shared from places""",
)
def _(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("crime", "poetry", "satire")])
    return places(spark, d).select(
        "ord", joined(F.array_sort(F.array_union("genres", "themes"))).alias("all_labels"),
        joined(F.array_sort(F.array_intersect("genres", wanted))).alias("shared"),
    )


# ---- K6 trigram search ----

_TRI = """list_distinct(flatten([[('  ' || w || ' ')[i:i + 2] for i in range(1, length(w) + 2)] for w in regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"""


def _sql_similarity(x: str, q: str) -> str:
    a, b = _TRI.format(x=x), _TRI.format(x=f"'{q}'")
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


@query(
    "k6_fuzzy_search",
    f"""with s as (select ord, id, passage, greatest({_sql_similarity('book_title', 'nation the')}, {_sql_similarity('author', 'nation the')}, {_sql_similarity('place_name', 'nation the')}) as r from places)
    select ord, id, round(r, 6) as match_rank from s where r >= 0.3 or contains(lower(passage), 'nation the') order by r desc, ord limit 50""",
)
def _(spark, d):
    return search.fuzzy_search(places(spark, d), "nation the", 50).select("ord", "id", F.round("match_rank", 6).alias("match_rank"))


@query(
    "k6_fuzzy_join",
    f"""with q as materialized (select ord as query_id, book_title as query, {_TRI.format(x='book_title')} as g from places where ord % 20 = 0),
    v as materialized (select value, {_TRI.format(x='value')} as g from (select book_title as value from places union select author from places union select place_name from places)),
    s as materialized (select query_id, query, value, coalesce(len(list_intersect(q.g, v.g)) / nullif(len(q.g) + len(v.g) - len(list_intersect(q.g, v.g)), 0), 0) as r from q, v),
    n as (select ord, unnest([book_title, author, place_name]) as value from places),
    m as (select query_id, query, ord, max(r) as r from s join n using (value) where r >= 0.3 group by all),
    k as (select *, row_number() over (partition by query_id order by r desc, ord) as rank from m)
    select query_id, query, rank, ord, round(r, 6) as match_rank from k where rank <= 10""",
)
def _(spark, d):
    p = places(spark, d)
    asked = p.filter("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("book_title").alias("query"))
    return fuzzy.fuzzy_join(p, asked, 10).select("query_id", "query", "rank", "ord", F.round("match_rank", 6).alias("match_rank"))
