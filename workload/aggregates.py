"""Profiles, reports, ranking and de-duplication over the place view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeatlas.operators import profiles, spatial
from tomeatlas.operators.dedup import dedup_best, dedup_first, top_k_per_group
from tomeatlas.operators.extract import summarise_entities
from tomeatlas.operators.joins import narrative_rows, place_reference
from tomeatlas.operators.select import enrichment_score, minmax, region_quotas, select_diverse
from tomeatlas.plans.ingest import expansion_stats, expansion_status
from tomeatlas.plans.release import dataset_meta, gate_report, quality_metrics
from tomeatlas.sources.writers import common_themes, hero_subset, slim_index
from workload.expressions import GATED_SQL, GRANULARITY_SQL, PASSED_SQL, gated
from workload.filters import LEDGER_SQL, _shifted, _SHIFTED_SQL, ledger
from workload.registry import query
from workload.tables import has_any, joined, norm, places, strip, table
from tomeatlas import vocab

# ---- G1 - G6: cities and corpus ----


@query(
    "g1_city_profile",
    f"""with {GATED_SQL}, p as (select *, lower(place_name) as city from gated where {PASSED_SQL}),
    b as (select city, count(*) as book_count from p group by 1 having count(*) >= 3),
    c as (select city, theme, count(*) as n from (select city, unnest(themes) as theme from p) group by 1, 2),
    r as (select *, row_number() over (partition by city order by n desc, theme) as rank, max(n) over (partition by city) as top from c),
    t as (select city, string_agg(theme || ':' || n || ':' || format('{{:.3f}}', round(n / top, 3)), '|' order by rank) as themes from r where rank <= 10 group by 1),
    a as (select city, list_sort(list_distinct(list(author)))[1:10] as authors, list_sort(list_distinct(list(language))) as languages from p group by 1),
    lang as (select city, language, row_number() over (partition by city order by count(*) desc, language) as rank from p group by 1, 2)
    select b.city, book_count, themes, array_to_string(authors, '|') as top_authors, array_to_string(languages, '|') as languages, lang.language as dominant_language
    from b join t using (city) join a using (city) join lang on lang.city = b.city and lang.rank = 1""",
)
def _(spark, d):
    rows = profiles.city_profile(gated(spark, d).filter("quality_passed"))
    themes = F.transform(
        "themes",
        lambda t: F.concat_ws(":", t["name"], t["book_count"].cast("string"), F.format_string("%.3f", t["weight"])),
    )
    return rows.select(
        "city", "book_count", joined(themes).alias("themes"), joined("top_authors").alias("top_authors"),
        joined("languages").alias("languages"), "dominant_language",
    )


_LABEL = "array_to_string([upper(w[1]) || w[2:] for w in string_split(theme, '_')], ' ')"
RADAR_SQL = f"""{GATED_SQL},
 per as (select place_name, count(*) as books, count(*) filter (where tier = 'gold' and len(themes) > 0) as gold,
  count(*) filter (where tier = 'silver' and len(themes) > 0) as silver from gated group by 1 having count(*) >= 3),
 scope as (select g.place_name, books, unnest(themes) as theme from gated g join per using (place_name)
  where case when gold >= 3 then tier = 'gold' when silver >= 3 then tier = 'silver' else true end),
 cnt as (select place_name, books, theme, count(*) as n from scope group by all),
 rk as (select *, row_number() over (partition by place_name order by n desc, theme) as rank, max(n) over (partition by place_name) as top,
  count(*) over (partition by place_name) as total_themes from cnt),
 radar as (select place_name as city, rank, {_LABEL} as label, n / top as value, n as theme_count, books as total_books, total_themes from rk where rank <= 8 and total_themes >= 3)"""


@query("g2_city_radar", f"with {RADAR_SQL} select city, rank, label, round(value, 6) as value, theme_count, total_books, total_themes from radar")
def _(spark, d):
    return profiles.city_radar(gated(spark, d)).withColumn("value", F.round("value", 6))


@query(
    "g3_compare_cities",
    f"""with {RADAR_SQL}, a as (select * from radar where city = 'Seattle'), b as (select * from radar where city = 'Texas')
    select label, round(coalesce(a.value, 0), 6) as value_a, round(coalesce(b.value, 0), 6) as value_b from a full join b using (label)
    order by a.rank nulls last, b.rank nulls last limit 10""",
)
def _(spark, d):
    both = profiles.compare_cities(profiles.city_radar(gated(spark, d)), "Seattle", "Texas")
    return both.withColumns({"value_a": F.round("value_a", 6), "value_b": F.round("value_b", 6)})


@query("g3_comparable_cities", "select place_name as city, count(*) as entries from places where place_name <> 'NATION_3' group by 1 having count(*) >= 3")
def _(spark, d):
    return profiles.comparable_cities(places(spark, d), "NATION_3")


@query(
    "g4_city_stats",
    """with dec as (select place_name, (publish_year // 10 * 10) || 's' as decade, count(*) as n from places where publish_year <> 0 group by 1, 2),
    r as (select *, row_number() over (partition by place_name order by n desc, decade) as rank from dec),
    t as (select place_name, string_agg(decade, '|' order by rank) as top_decades from r where rank <= 3 group by 1)
    select p.place_name, count(*) as entries, count(distinct author) as authors, count(distinct nullif(language, '')) as languages, coalesce(any_value(top_decades), '') as top_decades
    from places p left join t using (place_name) group by 1""",
)
def _(spark, d):
    return profiles.city_stats(places(spark, d)).withColumn("top_decades", joined("top_decades"))


@query("g5_corpus_stats", "select count(*) as places, count(distinct book_title) as works, count(distinct author) as authors, count(distinct place_name) as cities from places")
def _(spark, d):
    return profiles.corpus_stats(places(spark, d))


@query(
    "g6_facets",
    """select 'region' as facet, region as value, count(*) as entries from places group by 2 union all select 'language', coalesce(nullif(language, ''), 'Unknown'), count(*) from places group by 2
    union all select 'genre', g, count(*) from (select unnest(genres) as g from places) group by 2""",
)
def _(spark, d):
    return profiles.facets(places(spark, d))


# ---- G7, G8: reports ----

_METRICS = {
    "total": "true", "missing_passage": f"{strip('passage')} = ''", "missing_emotions": "len(emotions) = 0", "missing_themes": "len(themes) = 0",
    "bad_coordinates": "lon is null or lat is null or not (lon between -180 and 180 and lat between -90 and 90)",
    "null_island": "coalesce(abs(lon) < 0.01 and abs(lat) < 0.01, false)",
    "suspected_nonfiction": has_any("lower(book_title)", vocab.SUSPECT_TITLE_PARTS),
}
_COUNTED = {"source": "'unknown'", "region": "region", "language": "language", "passage_type": "'unknown'", "passage_source": "'unknown'", "quality_tier": "'unknown'"}


@query(
    "g7_quality_metrics",
    f"with s as (select p.* replace (x.lon as lon, x.lat as lat) from places p join ({_SHIFTED_SQL}) x using (ord)) "
    + " union all ".join(
        [f"select '{m}' as metric, '' as value, count(*) as entries from s where {c} having count(*) > 0" for m, c in _METRICS.items()]
        + [f"select '{m}', {c}, count(*) from s group by 2" for m, c in _COUNTED.items()]
        + [f"select 'duplicate_rows', '', count(*) - count(distinct ({norm('book_title')}, {norm('author')})) from s"]
    ),
)
def _(spark, d):
    return quality_metrics(_shifted(spark, d))


@query(
    "g8_gate_report",
    f"""with {GATED_SQL}, q as (select *, {PASSED_SQL} as passed from gated)
    select 'total' as section, 'total' as name, count(*) as entries from q union all select 'verdict', case when passed then 'passing' else 'failing' end, count(*) from q group by 2
    union all select 'tier', tier, count(*) from q group by 2 union all select 'geo_risk', f, count(*) from (select unnest(flags) as f from q) group by 2
    union all select 'stub_reason', 'vague_or_region_place', count(*) from q where tier = 'stub' and granularity = 'region' having count(*) > 0
    union all select 'stub_reason', 'missing_core_metadata', count(*) from q where tier = 'stub' and not ({strip('book_title')} <> '' and {strip('author')} <> '' and publish_year > 0) having count(*) > 0
    union all select 'stub_reason', 'empty_enrichment', count(*) from q where tier = 'stub' and len(themes) = 0 and len(emotions) = 0 having count(*) > 0""",
)
def _(spark, d):
    return gate_report(gated(spark, d))


# ---- G9 - G16 ----


@query(
    "g9_books_from_entries",
    """select book_title, author, arg_min(id, ord) as id, count(*) as entries, array_to_string(arg_min(genres, ord), '|') as genres,
     array_to_string(list_sort(list_distinct(list(place_name))), '|') as cities, array_to_string(list_sort(list_distinct(flatten(list(themes)))), '|') as themes,
     array_to_string(list_sort(list_distinct(flatten(list(emotions)))), '|') as emotions, count(*) filter (where passage <> '') as passages from places group by 1, 2""",
)
def _(spark, d):
    b = profiles.books_from_entries(places(spark, d))
    return b.select("book_title", "author", "id", "entries", "passages", *[joined(c).alias(c) for c in ("genres", "cities", "themes", "emotions")])


@query(
    "g9_book_places",
    """select l_orderkey as book_title, l_suppkey % 10 as author, arg_min(l_linenumber, l_linenumber) as first_line, count(*) as entries,
     string_agg(distinct l_returnflag, '|' order by l_returnflag) as cities from lineitem group by 1, 2""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("book_title"), (F.col("l_suppkey") % 10).alias("author"), F.col("l_linenumber").cast("bigint").alias("ord"),
        F.col("l_returnflag").alias("place_name"), F.lit("x").alias("id"), F.lit("").alias("passage"),
        *[F.array().cast("array<string>").alias(c) for c in ("genres", "themes", "emotions")],
    )
    return profiles.books_from_entries(li).select(
        "book_title", "author", F.col("ord").alias("first_line"), "entries", joined("cities").alias("cities")
    )


@query(
    "g10_place_reference",
    f"""select {norm('place_name')} as place_key, round(avg(lon), 6) as ref_lon, round(avg(lat), 6) as ref_lat from places where {GRANULARITY_SQL} = 'city' group by 1""",
)
def _(spark, d):
    return place_reference(places(spark, d)).select("place_key", F.round("ref_lon", 6).alias("ref_lon"), F.round("ref_lat", 6).alias("ref_lat"))


@query(
    "g11_bounds",
    """select region, round(w - greatest(e - w, 0.02) * 0.15, 6) as min_lng, round(e + greatest(e - w, 0.02) * 0.15, 6) as max_lng,
     round(s - greatest(n - s, 0.02) * 0.15, 6) as min_lat, round(n + greatest(n - s, 0.02) * 0.15, 6) as max_lat
    from (select region, min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from places group by 1)""",
)
def _(spark, d):
    b = spatial.bounds(places(spark, d), ["region"])
    return b.select("region", *[F.round(c, 6).alias(c) for c in ("min_lng", "max_lng", "min_lat", "max_lat")])


@query(
    "g12_city_clusters",
    "select place_name, count(*) as entries, count(distinct author) as authors, arg_min(lon, ord) as lon, arg_min(lat, ord) as lat from places group by 1 having count(*) >= 2",
)
def _(spark, d):
    return spatial.city_clusters(places(spark, d))


# several entries share a point
_SNAPPED_SQL = "select * replace (round(lon / 60) * 60 as lon, round(lat / 45) * 45 as lat) from gated"


def _snapped(spark, d):
    return gated(spark, d).withColumns({"lon": F.round(F.col("lon") / 60) * 60, "lat": F.round(F.col("lat") / 45) * 45})


@query(
    "g13_scatter_stacks",
    f"""with {GATED_SQL}, s as ({_SNAPPED_SQL}), r as (select *, row_number() over (partition by place_name, lon, lat order by (tier = 'gold') desc, length(passage) desc, ord) as rank from s)
    select place_name, lon + 0.0 as lon, lat + 0.0 as lat, count(*) as entries, round(avg(polarity), 6) as avg_polarity, max(case when rank = 1 then id end) as representative_id from r group by 1, 2, 3""",
)
def _(spark, d):
    s = spatial.scatter_stacks(_snapped(spark, d))
    return s.withColumns({"avg_polarity": F.round("avg_polarity", 6), "lon": F.col("lon") + 0.0, "lat": F.col("lat") + 0.0})


@query(
    "g14_background_stacks",
    f"""with {GATED_SQL}, s as ({_SNAPPED_SQL}) select place_name, lon + 0.0 as lon, lat + 0.0 as lat, count(*) as entries, round(avg(polarity), 6) as avg_polarity, arg_min(id, ord) as representative_id
    from s where not list_contains(genres, 'crime') group by 1, 2, 3""",
)
def _(spark, d):
    everything = _snapped(spark, d)
    chosen = everything.filter(F.array_contains("genres", "crime"))
    s = spatial.background_stacks(everything, chosen)
    return s.withColumns({"avg_polarity": F.round("avg_polarity", 6), "lon": F.col("lon") + 0.0, "lat": F.col("lat") + 0.0})


@query(
    "g15_density_grid",
    "select cast(floor(lon / 10.0) as bigint) as cx, cast(floor(lat / 10.0) as bigint) as cy, cast(sum(case when ord % 3 = 0 then 3 else 1 end) as bigint) as weight from places group by 1, 2",
)
def _(spark, d):
    setting = F.when(F.col("ord") % 3 == 0, F.lit("primary")).otherwise(F.lit("mentioned"))
    return spatial.density_grid(places(spark, d).withColumn("setting_type", setting), 10.0)


@query("g16_value_counts", "select language as value, count(*) as entries from places group by 1")
def _(spark, d):
    return profiles.value_counts(places(spark, d), "language")


@query(
    "g17_summarise_entities",
    """with e as (select lang as label, unnest(string_split(lower(text), ' ')) as text_key, n_chars / 1000.0::double as score from documents)
    select label, text_key, count(*) as entries, round(max(score), 6) as max_score from e group by 1, 2""",
)
def _(spark, d):
    words = table(spark, d, "documents").select(
        F.col("lang").alias("label"), (F.col("n_chars") / 1000.0).alias("score"), F.explode(F.split("text", " ")).alias("text")
    )
    return summarise_entities(words).withColumn("max_score", F.round("max_score", 6))


GRAPH_SQL = """select ord, 'Q' || (ord % 700) as book_qid, book_title as book_label, 'Q' || (ord % 40) as place_qid, place_name as place_label, 'Q1' as author_qid,
 author as author_label, nullif(publish_year, 0) as publication_year, language as language_label, case when ord % 3 = 0 then 'India' when ord % 3 = 1 then 'Atlantis' else '' end as country_label,
 case when ord % 8 = 0 then 0.001::double else lon end as longitude, case when ord % 8 = 0 then -0.002::double else lat end as latitude, genres as genre_labels from places"""


def graph_rows(spark, d):
    """Places as rows of a knowledge graph, some of them at null island."""
    o = F.col("ord")
    return places(spark, d).select(
        "ord", F.concat(F.lit("Q"), (o % 700).cast("string")).alias("book_qid"), F.col("book_title").alias("book_label"),
        F.concat(F.lit("Q"), (o % 40).cast("string")).alias("place_qid"), F.col("place_name").alias("place_label"), F.lit("Q1").alias("author_qid"),
        F.col("author").alias("author_label"), F.nullif("publish_year", F.lit(0)).alias("publication_year"), F.col("language").alias("language_label"),
        F.when(o % 3 == 0, F.lit("India")).when(o % 3 == 1, F.lit("Atlantis")).otherwise(F.lit("")).alias("country_label"),
        F.when(o % 8 == 0, F.lit(0.001)).otherwise(F.col("lon")).alias("longitude"), F.when(o % 8 == 0, F.lit(-0.002)).otherwise(F.col("lat")).alias("latitude"),
        F.col("genres").alias("genre_labels"),
    )


def known_part(spark, d):
    """The part of the dataset that counts as known before an expansion."""
    return places(spark, d).filter(F.array_contains("genres", "crime"))


STATUS_SQL = f"""known as (select distinct {norm('book_title')} as t, {norm('author')} as a from places where list_contains(genres, 'crime')),
 g as (select *, {norm('book_label')} as t, {norm('author_label')} as a, abs(latitude) < 0.01 and abs(longitude) < 0.01 as island from ({GRAPH_SQL})),
 f as (select t, a, min(ord) as first_ok from g where not island group by 1, 2),
 status as (select g.*, case when k.t is not null or g.ord > f.first_ok then 'deduped' when island then 'rejected' else 'new' end as status
  from g left join known k on k.t = g.t and k.a = g.a left join f on f.t = g.t and f.a = g.a)"""


@query(
    "g19_ledger_summary",
    f"""with g as ({LEDGER_SQL}) select count(*) as total_rows, count(*) filter (where status = 'reviewed') as reviewed_rows, round(count(*) filter (where status = 'reviewed') / count(*), 6) as reviewed_coverage_rate,
     count(*) filter (where len(places_named) <= 1) as single_place_rows, count(*) filter (where len(places_named) > 1) as multi_place_rows, count(*) filter (where record_type = 'unknown') as unknown_rows,
     count(*) filter (where record_type = 'fictional') as fictional_rows, count(*) filter (where record_type = 'nonfiction') as nonfiction_rows, count(*) filter (where record_type = 'narrative') as narrative_rows from g""",
)
def _(spark, d):
    s = profiles.ledger_summary(ledger(spark, d))
    return s.withColumn("reviewed_coverage_rate", F.round("reviewed_coverage_rate", 6))


@query(
    "g19_ledger_counts",
    f"with g as ({LEDGER_SQL}) select 'record_type' as counter, record_type as value, count(*) as entries from g group by 2 union all select 'system_tier', system_tier, count(*) from g group by 2",
)
def _(spark, d):
    return profiles.ledger_counts(ledger(spark, d))


@query("g20_dataset_meta", "select 'v1' as version, count(*) as total_entries, 0.55::double as quality_threshold, 'places' as source, null as built_at from places")
def _(spark, d):
    return dataset_meta(places(spark, d), "v1", "places", 0.55, None)


@query(
    "g21_narrative_rows",
    "select author, place_name, string_agg(distinct g, '|' order by g) as genre_labels from (select author, place_name, unnest(genres) as g from places) group by 1, 2",
)
def _(spark, d):
    rows = places(spark, d).select("author", "place_name", F.explode("genres").alias("genre"))
    return narrative_rows(rows, ["author", "place_name"])


# ---- L: ranking, de-duplication, selection ----


@query("l1_dedup_first", "select author, place_name, min(ord) as ord from places group by 1, 2")
def _(spark, d):
    return dedup_first(places(spark, d), ["author", "place_name"]).select("author", "place_name", "ord")


_DUP_SQL = "select * replace (author as book_title) from places"


@query(
    "l2_dedup_best",
    f"""with p as ({_DUP_SQL}) select ord, row_number() over (partition by {norm('book_title')}, {norm('author')}, {norm('place_name')}
     order by len(themes) desc, len(emotions) desc, length({strip('passage')}) desc, ord) = 1 as kept from p""",
)
def _(spark, d):
    kept, removed = dedup_best(places(spark, d).withColumn("book_title", F.col("author")))
    return kept.select("ord", F.lit(True).alias("kept")).unionByName(removed.select("ord", F.lit(False).alias("kept")))


@query(
    "l3_author_timeline",
    """with s as (select author, place_name, publish_year, min(ord) as ord from places where publish_year <> 0 group by 1, 2, 3),
    c as (select author, count(distinct place_name) as cities from s group by 1 having count(distinct place_name) >= 3)
    select author, place_name, publish_year, ord, cities, row_number() over (partition by author order by publish_year, ord) as step from s join c using (author)""",
)
def _(spark, d):
    return profiles.author_timeline(places(spark, d)).select("author", "place_name", "publish_year", "ord", "cities", "step")


@query(
    "l5_minmax",
    "select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as scaled from orders",
)
def _(spark, d):
    return minmax(table(spark, d, "orders"), {"o_totalprice": "scaled"}).select("o_orderkey", F.round("scaled", 6).alias("scaled"))


EDITIONS_SQL = f"select {norm('book_title')} as t, {norm('author')} as a, sum(ord % 17) as edition_count from places group by 1, 2"


def editions(spark, d):
    """Edition counts per work."""
    from tomeatlas.operators.dedup import with_book_key

    return with_book_key(places(spark, d)).groupBy("title_key", "author_key").agg(F.sum(F.col("ord") % 17).alias("edition_count"))


SCORED_SQL = f"""ed as ({EDITIONS_SQL}),
 au as (select {norm('author')} as a, 0.6::double * ln(1 + count(*)) + 0.4::double * ln(1 + count(distinct {norm('book_title')})) as canon from places group by 1),
 raw as (select p.*, edition_count, canon, case when {strip('passage')} <> '' then 0.15::double else 0.0::double end as bonus from places p
  join ed on ed.t = {norm('book_title')} and ed.a = {norm('author')} join au on au.a = {norm('author')}),
 scored as (select *, 0.72::double * (edition_count - min(edition_count) over ()) / (max(edition_count) over () - min(edition_count) over ())
  + 0.28::double * coalesce((canon - min(canon) over ()) / nullif(max(canon) over () - min(canon) over (), 0), 0) + bonus as base_score from raw)"""


@query("l6_enrichment_score", f"with {SCORED_SQL} select ord, cast(edition_count as bigint) as edition_count, round(canon, 6) as canon_raw, round(base_score, 6) as base_score from scored")
def _(spark, d):
    s = enrichment_score(places(spark, d), editions(spark, d))
    return s.select("ord", "edition_count", F.round("canon_raw", 6).alias("canon_raw"), F.round("base_score", 6).alias("base_score"))


_UNEVEN_SQL = "select region || case when list_contains(genres, 'crime') then '-c' when list_contains(genres, 'poetry') then '-p' else '' end as region from places"


@query(
    "l7_region_quotas",
    f"""with c as (select region, count(*) as rows from ({_UNEVEN_SQL}) group by 1),
    q0 as (select *, least(greatest(15, cast(floor(400 * sqrt(rows / sum(rows) over ()) / (select sum(sqrt(rows / (select sum(rows) from c))) from c)) as bigint)), rows) as q from c),
    t as (select least(400, sum(rows)) as target, sum(q) as total from q0),
    down as (select q0.*, row_number() over (order by q desc, region) as pos, greatest(q - 15, 0) as room from q0),
    rounds as (select r, (select sum(least(room, r)) from down) as given from range(0, 401) x(r)),
    best as (select max(r) as r, max(given) as given from rounds, t where given <= greatest(total - target, 0)),
    cut as (select down.*, case when room > best.r then row_number() over (partition by room > best.r order by pos) end as turn, best.r, best.given from down, best),
    shaved as (select region, rows, q - least(room, r) - case when turn <= greatest(total - target, 0) - given then 1 else 0 end as q from cut, t),
    t2 as (select (select target from t) - sum(q) as missing from shaved),
    up as (select *, row_number() over (order by rows - q desc, region) as pos, rows - q as room from shaved),
    rounds2 as (select r, (select sum(least(room, r)) from up) as given from range(0, 401) x(r)),
    best2 as (select max(r) as r, max(given) as given from rounds2, t2 where given <= greatest(missing, 0)),
    add2 as (select up.*, case when room > best2.r then row_number() over (partition by room > best2.r order by pos) end as turn, best2.r, best2.given from up, best2)
    select region, rows, cast(q + least(room, r) + case when turn <= greatest(missing, 0) - given then 1 else 0 end as bigint) as quota from add2, t2""",
)
def _(spark, d):
    tail = F.when(F.array_contains("genres", "crime"), F.lit("-c")).when(F.array_contains("genres", "poetry"), F.lit("-p")).otherwise(F.lit(""))
    return region_quotas(places(spark, d).select(F.concat("region", tail).alias("region")), 400)


@query("l8_select_diverse")
def _(spark, d):
    picked = select_diverse(enrichment_score(places(spark, d), editions(spark, d)), 100)
    return picked.withColumns({"final_score": F.round("final_score", 6), "base_score": F.round("base_score", 6)})


@query(
    "l10_top_k_per_group",
    "select author, ord, rank from (select author, ord, row_number() over (partition by author order by polarity desc, ord) as rank from places) where rank <= 5",
)
def _(spark, d):
    return top_k_per_group(places(spark, d), ["author"], [F.col("polarity").desc(), "ord"], 5).select("author", "ord", "rank")


# ---- B4, B6: served subsets ----


@query(
    "b4_slim_index",
    f"""with {GATED_SQL} select id, book_title as "bookTitle", author, place_name as "placeName", round(lon, 6) || ' ' || round(lat, 6) as coordinates, region, polarity as sp, tier as qt, granularity as pg,
     publish_year as "publishYear", '' as "coverUrl", language, array_to_string(genres[1:3], '|') as g, array_to_string(themes[1:5], '|') as t from gated""",
)
def _(spark, d):
    slim = slim_index(gated(spark, d))
    at = F.concat_ws(" ", *[F.round(F.get("coordinates", F.lit(i)), 6).cast("string") for i in (0, 1)])
    return slim.withColumns({"coordinates": at, "g": joined("g"), "t": joined("t")})


@query(
    "b6_hero_subset",
    """select ord, id, hero_score from (select ord, id, case when len(emotions) >= 3 then 2 else 0 end + case when len(themes) >= 2 then 2 else 0 end + case when polarity <> 0 then 1 else 0 end
     + case when length(passage) > 50 then 2 else 0 end as hero_score from places) order by hero_score desc, ord limit 50""",
)
def _(spark, d):
    return hero_subset(places(spark, d), 50).select("ord", "id", "hero_score")


@query("b6_common_themes", "select theme, count(*) as entries from (select unnest(themes) as theme from places) group by 1 having count(*) >= 2")
def _(spark, d):
    return common_themes(places(spark, d))


