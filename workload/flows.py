"""Whole flows over the place view: clean-up, gate, ingest, enrichment, serving, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.operators.joins import country_regions
from tomeatlas.plans import cleanup, enrich, ingest, release, serving
from tomeatlas.plans.scratch import materialise, scratch_path
from tomeatlas.sources import parsers
from tomeatlas.streaming import intake, limiter
from tomeatlas.streaming.keyed import state_session
from workload.aggregates import GRAPH_SQL, RADAR_SQL, STATUS_SQL, editions, graph_rows, known_part
from workload.expressions import GATED_SQL, PASSED_SQL, gated, prepared
from workload.filters import (
    AMBIGUOUS_SQL,
    MISMATCH_SQL,
    NONFICTION_SQL,
    _titled,
    _TITLED_SQL,
    contributions,
)
from workload.io import CATALOGUE_SQL, SHEET_SQL, bindings, catalogue_answers, sheet
from workload.joins import _SEEDS, SIMILAR_SQL, _sql_distance, nations
from workload.registry import query
from workload.tables import joined, norm, places, sql_map, strip, table
from workload.text import scripted_model

# ---- P1: clean-up ----


def untidy(spark, d):
    """Rows with every kind of fault the clean-up looks for."""
    p, t = places(spark, d), _titled(spark, d)
    label = F.when(F.col("ord") % 22 == 0, F.concat("place_name", F.lit("; Elsewhere")))
    rest = p.select("ord", "id", "publish_year", "language", "lon", "lat", "polarity", "emotions", "themes")
    return t.join(rest, "ord").withColumn("place_name", F.coalesce(label, "place_name"))


UNTIDY_SQL = f"""t as ({_TITLED_SQL}),
 untidy as (select t.* replace (case when t.ord % 22 = 0 then t.place_name || '; Elsewhere' else t.place_name end as place_name), p.id, p.publish_year, p.language, p.lon, p.lat, p.polarity, p.emotions, p.themes
  from t join places p using (ord)),
 judged as (select *, case when {NONFICTION_SQL} then 'nonfiction_title' when {AMBIGUOUS_SQL} then 'ambiguous_title' when {MISMATCH_SQL} then 'title_city_mismatch' end as reason from untidy),
 base as (select * exclude (reason) from judged where reason is null)"""


def _cleanup_sql() -> str:
    from workload.joins import SPLIT_SQL

    return f"""{UNTIDY_SQL}, {SPLIT_SQL},
     atomic as (select * from split where split_status <> 'unresolved'),
     best as (select *, row_number() over (partition by {norm('book_title')}, {norm('author')}, {norm('place_name')} order by len(themes) desc, len(emotions) desc, length({strip('passage')}) desc, ord, pos) as rank from atomic),
     gone as (select reason from judged where reason is not null union all select 'composite_place_unresolved' from split where split_status = 'unresolved'
      union all select 'composite_place_unresolved' from (select distinct ord from split where split_status = 'unresolved') union all select 'duplicate_title_author_place' from best where rank > 1)"""


@query("p1_cleanup_report", f"with {_cleanup_sql()} select reason, count(*) as entries from gone group by 1")
def _(spark, d):
    return cleanup.run_cleanup(untidy(spark, d))["report"]


@query(
    "p1_cleanup_data",
    f"""with {_cleanup_sql()} select id, book_title, place_name, case when split_status = 'resolved' then 0.8::double else 0.85::double end as confidence, split_status = 'resolved' as was_split from best where rank = 1""",
)
def _(spark, d):
    data = cleanup.run_cleanup(untidy(spark, d))["data"]
    return data.select(
        "id", "book_title", "place_name", F.col("coordinate_confidence").alias("confidence"),
        F.col("composite_split_part").isNotNull().alias("was_split"),
    )


@query(
    "p1_cleanup_removed",
    f"""with {_cleanup_sql()} select id, book_title, author, place_name, reason from judged where reason is not null
    union all select id, book_title, author, place_name, 'composite_place_unresolved' from split where split_status = 'unresolved'
    union all select id, book_title, author, place_name, 'composite_place_unresolved' from base where ord in (select ord from split where split_status = 'unresolved')
    union all select id, book_title, author, place_name, 'duplicate_title_author_place' from best where rank > 1""",
)
def _(spark, d):
    return cleanup.run_cleanup(untidy(spark, d))["removed"]


@query(
    "b10_removal_counts",
    f"with {UNTIDY_SQL} select reason, count(*) as entries from judged where reason is not null group by 1",
)
def _(spark, d):
    tagged = untidy(spark, d).withColumn("reason", cleanup.removal_reason()).filter(F.col("reason").isNotNull())
    return cleanup.removal_counts(cleanup.cleanup_manifest(tagged))


# ---- P2: gate ----


@query(
    "p2_gate_release",
    f"""with {GATED_SQL} select ord, tier, quality_score from gated where {PASSED_SQL}""",
)
def _(spark, d):
    out = release.run_gate(prepared(spark, d), reject=True)
    return out["data"].select("ord", F.col("quality_tier").alias("tier"), "quality_score")


@query(
    "p2_passing_ratio",
    f"with {GATED_SQL} select count(*) filter (where {PASSED_SQL}) as passing, count(*) filter (where not {PASSED_SQL}) as failing, round(count(*) filter (where {PASSED_SQL}) / count(*), 6) as passing_ratio from gated",
)
def _(spark, d):
    ratio = release.passing_ratio(release.gate_report(gated(spark, d)))
    return ratio.withColumn("passing_ratio", F.round("passing_ratio", 6))


_ROW_TEXT = "concat_ws(chr(31), " + ", ".join(
    {"lon": "cast(round(lon * 1000000) as bigint)", "lat": "cast(round(lat * 1000000) as bigint)", "polarity": "cast(round(polarity * 1000000) as bigint)"}.get(c)
    or (f"coalesce(array_to_string({c}, '|'), '')" if c in ("themes", "emotions", "genres") else f"coalesce(cast({c} as varchar), '')")
    for c in sorted(["ord", "id", "book_title", "author", "publish_year", "place_name", "region", "language", "lon", "lat", "passage", "polarity", "themes", "emotions", "genres"])
) + ")"


@query(
    "b9_release_manifest",
    f"select 'v1' as version, count(*) as entries, cast(sum(cast('0x' || left(sha256({_ROW_TEXT}), 15) as hugeint)) as varchar) as digest from places",
)
def _(spark, d):
    return release.release_manifest(places(spark, d), "v1").select("version", "entries", "digest")


# ---- P3: catalogue ----

_CITY_SQL = "(values ('Bombay', 0, 1, 'Mumbai'), ('Mumbai', 0, 0, 'Mumbai'), ('London', 42, 0, 'London'), ('Paris', 43, 0, 'Paris')) n(search_name, city_ord, name_ord, city)"


@query(
    "p3_catalogue_ingest",
    f"""with {CATALOGUE_SQL}, named as (select a.*, ['Bombay', 'London', 'Mumbai', 'Paris'][cast(ord % 4 as int) + 1] as search_name from a),
    r as (select *, row_number() over (partition by work_key order by city_ord, name_ord, position, ord) as rank from named join {_CITY_SQL} using (search_name))
    select 'ol-' || split_part(work_key, '/', 3) || '-' || lower(city) as id, title as book_title, author, city as place_name, case when year is null then '' else year || 's' end as narrative_era, 'French' as language from r
    where rank = 1 and {strip('title')} <> ''""",
)
def _(spark, d):
    names = ingest.search_names(spark, ingest.seed_cities(spark))
    # several answers per name: the position runs over all of them
    books = parsers.parse_catalogue_docs(catalogue_answers(spark, d), keep=("ord", "search_name"))
    books = books.withColumn("position", F.struct("position", "ord")).drop("ord")
    return ingest.run_catalogue_ingest(books, names)["data"].select("id", "book_title", "author", "place_name", "narrative_era", "language")


@query(
    "c1_catalogue_to_entries",
    f"""with {CATALOGUE_SQL} select 'ol-' || split_part(work_key, '/', 3) || '-new-york' as id, title as book_title, coalesce(year, 0) as publish_year, title as passage,
     case when year is null then '' else year || 's' end as narrative_era, 'French' as language, cover_id <> 0 as has_cover from a""",
)
def _(spark, d):
    books = parsers.parse_catalogue_docs(catalogue_answers(spark, d)).withColumns(
        {"city": F.lit("New York"), "lon": F.lit(-74.006), "lat": F.lit(40.7128), "region": F.lit("North America"), "description": F.col("title")}
    )
    entries = ingest.catalogue_to_entries(books)
    return entries.select("id", "book_title", "publish_year", "passage", "narrative_era", "language", F.col("cover_url").isNotNull().alias("has_cover"))


# ---- P4: graph ----

_REGIONS = sql_map(country_regions())
_SEED_INFO = "(values " + ", ".join(f"({i}, '{r[3]}', '{r[4]}')" for i, r in enumerate(vocab.SEED_CITIES)) + ") si(i, sregion, scountry)"


@query(
    "p4_graph_expansion",
    f"""with {STATUS_SQL}, n as (select * from status where status = 'new'),
    x as (select ord, i, city, {_sql_distance('longitude', 'latitude', 'clon', 'clat', '6371.0')} as km from n, {_SEEDS}),
    near as (select *, row_number() over (partition by ord order by km, i) as rank from x)
    select 'wd-' || book_qid || '-' || place_qid as id, book_label as book_title, case when publication_year is null then '' else publication_year || 's' end as narrative_era, coalesce({_REGIONS}[country_label], sregion) as region,
     coalesce(nullif(country_label, ''), scountry) as country, city as nearest_known_city, round(km, 2) as nearest_known_city_distance_km, {_REGIONS}[country_label] is null as region_inferred, case when km > 500 then 'far_from_known_city' else '' end as qa_flags
    from n join near using (ord) join {_SEED_INFO} using (i) where rank = 1""",
)
def _(spark, d):
    out = ingest.run_expansion(known_part(spark, d), graph_rows(spark, d), ingest.country_region_table(spark))
    fields = ("id", "book_title", "narrative_era", "region", "country", "nearest_known_city", "nearest_known_city_distance_km", "region_inferred")
    return out["new"].select(*fields, joined("qa_flags").alias("qa_flags"))


@query(
    "c2_narrative_to_entries",
    f"""with g as ({GRAPH_SQL}), n as (select * from g where not (abs(latitude) < 0.01 and abs(longitude) < 0.01)),
    x as (select ord, i, city, {_sql_distance('longitude', 'latitude', 'clon', 'clat', '6371.0')} as km from n, {_SEEDS}),
    near as (select *, row_number() over (partition by ord order by km, i) as rank from x)
    select ord, 'wd-' || book_qid || '-' || place_qid as id, coalesce({_REGIONS}[country_label], sregion) as region, city as nearest_known_city, km > 500 as far from n join near using (ord) join {_SEED_INFO} using (i) where rank = 1""",
)
def _(spark, d):
    e = ingest.narrative_to_entries(graph_rows(spark, d), ingest.country_region_table(spark))
    return e.select("ord", "id", "region", "nearest_known_city", F.array_contains("qa_flags", "far_from_known_city").alias("far"))


@query(
    "g18_expansion_stats",
    f"""with {STATUS_SQL}, n as (select * from status where status = 'new'),
    x as (select ord, {_sql_distance('longitude', 'latitude', 'clon', 'clat', '6371.0')} as km from n, {_SEEDS}), near as (select ord, min(km) as km from x group by 1)
    select (select count(*) from places where list_contains(genres, 'crime')) as existing, count(*) as fetched, count(*) filter (where status = 'deduped') as deduped,
     count(*) filter (where status = 'rejected') as rejected_null_island, count(*) filter (where status = 'new') as new_entries, (select count(*) from near where km > 500) as flagged_far from status""",
)
def _(spark, d):
    return ingest.run_expansion(known_part(spark, d), graph_rows(spark, d), ingest.country_region_table(spark))["report"]


@query("p4_graph_from_bindings")
def _(spark, d):
    rows = parsers.parse_narrative_bindings(bindings(spark, d))
    out = ingest.run_expansion(known_part(spark, d), rows, ingest.country_region_table(spark))
    return out["data"].select("ord", "id", "book_title", "region", "nearest_known_city")


# ---- P5: sheet, P6: passages ----


@query(
    "p5_sheet_merge",
    f"""with {SHEET_SQL}, known as (select distinct lower(book_title) as t, lower(place_name) as p from places where list_contains(genres, 'crime')),
    f as (select *, row_number() over (partition by lower(book_title), lower(place_name) order by ord) as rank from entries)
    select id, place_name from f where rank = 1 and (lower(book_title), lower(place_name)) not in (select (t, p) from known) union all select id, place_name from places where list_contains(genres, 'crime')""",
)
def _(spark, d):
    out = ingest.run_sheet_merge(known_part(spark, d), sheet(spark, d), nations(spark, d))
    return out["data"].select("id", "place_name")


@query(
    "p6_backfill_report",
    f"""with src as (select 'doc-' || doc_id as id, length({strip('text')}) as n from documents), b as (select p.id, length({strip('passage')}) as old, n from places p join src using (id))
    select case when n < 60 then 'kept' when old < 60 then 'new' when n > old then 'upgraded' else 'replaced' end as merge_status, count(*) as entries from b group by 1""",
)
def _(spark, d):
    texts = table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("passage"), F.col("doc_id").alias("ord")
    )
    return ingest.run_backfill(places(spark, d), [("openlibrary", texts)])["report"]


# ---- P7: enrichment, P8: serving ----


@query("p7_enrichment")
def _(spark, d):
    bare = places(spark, d).withColumn("polarity", F.lit(0.0))
    out = enrich.run_enrichment(bare, editions(spark, d), scripted_model, 100, "m1")
    return out["data"].select("ord", "polarity", joined("themes").alias("themes"), "enrichment_method", "enriched_by_model")


@query(
    "p8_serving_counts",
    f"""with {RADAR_SQL}, perc as (select lower(place_name) as c, count(*) as n, sum(len(themes)) as k from gated group by 1)
    select 'index' as "table", count(*) as entries from gated union all select 'details', count(*) from gated union all select 'hero', least(500, count(*)) from gated
    union all select 'themes', count(*) from (select t from (select unnest(themes) as t from gated) group by 1 having count(*) >= 2) union all select 'corpus', 1
    union all select 'facets', count(distinct region) + count(distinct language) + (select count(distinct g) from (select unnest(genres) as g from gated)) from gated
    union all select 'city_profiles', count(*) filter (where n >= 3 and k > 0) from perc union all select 'city_stats', count(distinct place_name) from gated
    union all select 'city_radar', count(*) from radar union all select 'cities', count(*) from (select place_name from gated group by 1 having count(*) >= 3) union all select 'reading_lists', 5""",
)
def _(spark, d):
    root = scratch_path(spark, "serving")
    rated = materialise(gated(spark, d), "gated")
    tables = serving.serving_tables(rated)
    serving.write_serving_tables(tables, root)
    return serving.serving_counts({name: spark.read.parquet(f"{root}/{name}") for name in tables})


@query("p8_similar_table", SIMILAR_SQL)
def _(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    rows = places(spark, d)
    similar = serving.serving_tables(rows, vectors, shown=rows.filter("ord % 20 = 0"))["similar"]
    return similar.select("ord", "book_title", "similar_title", "rank", "score", joined("shared_themes").alias("shared_themes"))


# ---- N: streams ----


#: Rows of one file of a stream, about.
STREAM_FILE_ROWS = 10_000


def _as_stream(spark: SparkSession, df: DataFrame, name: str, files: int = 5) -> DataFrame:
    """The rows as a stream of ``files`` micro-batches, in a session that can hold state; one of many rows has several files, so no task reads it whole."""
    path = scratch_path(spark, name)
    pieces = max(1, -(-df.count() // (files * STREAM_FILE_ROWS)))
    df.repartition(files * pieces).write.parquet(path)
    return state_session(spark).readStream.schema(df.schema).option("maxFilesPerTrigger", pieces).parquet(path)


@query(
    "n1_contribution_stream",
    f"""with c as (select ord, case when ord % 12 = 0 or {strip('book_title')} = '' then 'missing book_title' when {strip('passage')} = '' then 'missing passage' when ord % 14 = 0 then 'missing themes'
      when ord % 10 = 0 then 'coordinates must be [longitude, latitude]' when ord % 7 = 0 and lon + 400 > 180 then 'coordinates out of range' end as fault from places)
    select ord, fault, case when fault is null then 'pending' else 'rejected' end as status from c""",
)
def _(spark, d):
    root = scratch_path(spark, "intake")
    stream = _as_stream(spark, contributions(spark, d), "contributions")
    intake.contribution_stream(stream, f"{root}/queue", f"{root}/faults", f"{root}/checkpoint").awaitTermination()
    queue, faults = spark.read.parquet(f"{root}/queue"), spark.read.parquet(f"{root}/faults")
    return queue.select("ord", F.lit(None).cast("string").alias("fault"), "status").unionByName(faults.select("ord", "fault", "status"))


@query(
    "n2_enrichment_stream",
    "select ord || ':' || id as row_key, case when length(passage) > 100 then 'ok' else 'failed' end as status from places",
)
def _(spark, d):
    from tomeatlas.operators.dedup import with_row_key

    rows = with_row_key(places(spark, d)).select("row_key", "ord", "id", "passage")
    again = rows.filter(F.length("passage") > 300)
    root = scratch_path(spark, "enrichment")
    stream = _as_stream(spark, rows.unionByName(again), "to-enrich", 3)
    intake.enrichment_stream(stream, scripted_model, f"{root}/results", f"{root}/checkpoint").awaitTermination()
    return intake.read_stream_results(spark.read.parquet(f"{root}/results")).select("row_key", "status")


@query(
    "n3_append_stream",
    f"""with k as (select *, {norm('book_title')} as t, {norm('author')} as a from places), known as (select distinct t, a from k where list_contains(genres, 'crime'))
    select t as title, a as author from k where list_contains(genres, 'crime') union all select distinct t, a from k where (t, a) not in (select (t, a) from known)""",
)
def _(spark, d):
    root = scratch_path(spark, "append")
    p = places(spark, d).withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord"))).select("ord", "id", "book_title", "author", "genres", "seen_at")
    intake.seed_corpus(p.filter(F.array_contains("genres", "crime")), f"{root}/corpus")
    stream = _as_stream(spark, p, "arrivals", 3)
    intake.append_stream(stream, f"{root}/corpus", f"{root}/checkpoint").awaitTermination()
    corpus = spark.read.parquet(f"{root}/corpus")
    return corpus.select(F.col("key0").alias("title"), F.col("key1").alias("author"))


def timed_events(spark, d):
    """Events with times squeezed together, so that keys run into the limit."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    squeezed = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600)).alias("ts")
    return e.select("event_id", "user_id", squeezed)


RATE_LIMIT_SQL = """with recursive e as (select event_id, user_id, floor(epoch(ts) / 600) as t from events),
    o as (select *, row_number() over (partition by user_id order by t, event_id) as i from e),
    w as (select user_id, i, event_id, [t] as recent, true as accepted from o where i = 1
     union all select o.user_id, o.i, o.event_id, case when len(list_filter(w.recent, lambda r: o.t - r <= 60)) < 3 then list_append(list_filter(w.recent, lambda r: o.t - r <= 60), o.t) else list_filter(w.recent, lambda r: o.t - r <= 60) end,
      len(list_filter(w.recent, lambda r: o.t - r <= 60)) < 3 from w join o on o.user_id = w.user_id and o.i = w.i + 1)
    select event_id, user_id, accepted from w"""


@query("n4_rate_limit", RATE_LIMIT_SQL)
def _(spark, d):
    return limiter.rate_limit(timed_events(spark, d), "user_id", "ts", 3).select("event_id", "user_id", "accepted")


@query("n4_rate_limit_stream", RATE_LIMIT_SQL)
def _(spark, d):
    rows = timed_events(spark, d)
    root = scratch_path(spark, "limiter")
    # events arrive in five spans of time, each in four files
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / 5
    for i in range(5):
        since, until = span["lo"] + step * i, span["lo"] + step * (i + 1)
        part = rows.filter((F.col("ts") >= F.lit(since)) & ((F.col("ts") < F.lit(until)) if i < 4 else F.lit(True)))
        part.repartition(4).write.mode("append").parquet(f"{root}/in")
    stream = state_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    out = limiter.rate_limit_stream(stream, "user_id", "ts", 3, late_s=60)
    sink = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "accepted")


