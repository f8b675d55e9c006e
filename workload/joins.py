"""Joins: dimensions, passages, geocoding, splits, radius and nearest neighbours, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.operators import joins, profiles, spatial, vector_index, vectors
from tomeatlas.operators.dedup import append_new, pending, select_keys, with_row_key
from workload.aggregates import GRAPH_SQL, graph_rows
from workload.expressions import _SPLIT, COMPOSITE_SQL, GRANULARITY_SQL, sql_ordered_distinct
from workload.registry import query
from workload.tables import (
    joined,
    norm,
    places,


    sql_map,
    strip,
    table,
)

# ---- E1 - E3 ----


@query(
    "e1_denormalise",
    """select l_orderkey as book_id, l_linenumber as line, o_orderpriority as title, c_name as author, s_name as place from lineitem
    join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey""",
)
def _(spark, d):
    bp = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("place_id"), F.col("l_linenumber").alias("line")
    )
    books = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("book_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("title")
    )
    authors = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"))
    where = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("place"))
    return joins.denormalise(bp, books, authors, where).select("book_id", "line", "title", "author", "place")


@query(
    "e2_merge_passages",
    f"""with src as (select 'doc-' || (doc_id // 2) as id, {strip('text')} as text, 'openlibrary' as tag, 0 as src, doc_id as ord from documents
      union all select 'doc-' || (doc_id // 3), {strip('text')}, 'wikipedia', 1, doc_id from documents),
    best as (select *, row_number() over (partition by id order by length(text) desc, src, ord) as rank from src where length(text) >= 60),
    base as (select *, {strip('passage')} as old from places)
    select base.id, coalesce(b.text, case when old <> '' and length(old) < 60 then '' else passage end) as passage, b.tag as passage_source,
     case when b.text is null then 'kept' when old = '' or length(old) < 60 then 'new' when length(b.text) > length(old) then 'upgraded' else 'replaced' end as merge_status
    from base left join best b on b.id = base.id and b.rank = 1""",
)
def _(spark, d):
    docs = table(spark, d, "documents")

    def source(step: int):
        return docs.select(
            F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / step).cast("string")).alias("id"),
            F.col("text").alias("passage"), F.col("doc_id").alias("ord"),
        )

    sources = [("openlibrary", source(2)), ("wikipedia", source(3))]
    merged = joins.merge_passages(places(spark, d), sources)
    return merged.select("id", "passage", "passage_source", "merge_status")


@query(
    "e3_with_region",
    f"""with m as (select {sql_map(joins.country_regions())} as regions)
    select ord, coalesce(regions[country_label], place_label) as region, coalesce(nullif(country_label, ''), author_label) as country, regions[country_label] is null as region_inferred
    from ({GRAPH_SQL}), m""",
)
def _(spark, d):
    from tomeatlas.plans.ingest import country_region_table

    rows = graph_rows(spark, d).withColumns(
        {"country": F.col("country_label"), "nearest_region": F.col("place_label"), "nearest_country": F.col("author_label")}
    )
    return joins.with_region(rows, country_region_table(spark)).select("ord", "region", "country", "region_inferred")


# ---- E4: geocoding against the nations ----

NATION_AT = "(n_nationkey * 53 % 340) - 170 + 0.25::double as lon, (n_nationkey * 31 % 150) - 75 + 0.5::double as lat"


def nations(spark, d):
    """Nations as a gazetteer, with coordinates from their key."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.cast("bigint").alias("ord"), F.col("n_name").alias("name"), (k * 53 % 340 - 170 + F.lit(0.25)).alias("lon"),
        (k * 31 % 150 - 75 + F.lit(0.5)).alias("lat"), F.concat(F.lit("country "), k.cast("string")).alias("country"),
    )


_CELL = """case ord % 4 when 0 then place_name when 1 then 'north of ' || place_name when 2 then place_name || ', ' || region else 'Bombay or ' || lower(region) end"""


@query(
    "e4_geocode",
    f"""with c as (select ord, {_CELL} as cell from places), gz as (select n_nationkey as g, n_name, {NATION_AT} from nation),
    f as (select *, case when contains(lower(cell), 'bombay') then 'Mumbai' when contains(cell, ',') then trim(split_part(cell, ',', 1)) else cell end as display_city from c),
    ex as (select ord, lon, lat from f join gz on n_name = display_city),
    ins as (select ord, arg_min(lon, g) as lon, arg_min(lat, g) as lat from f join gz on contains(lower(cell), lower(n_name)) where ord not in (select ord from ex) group by 1),
    r as (select * from ex union all select * from ins)
    select f.ord, display_city, r.lon, r.lat from f left join r using (ord)""",
)
def _(spark, d):
    m, name = F.col("ord") % 4, F.col("place_name")
    cell = (
        F.when(m == 0, name).when(m == 1, F.concat(F.lit("north of "), name)).when(m == 2, F.concat_ws(", ", name, "region"))
        .otherwise(F.concat(F.lit("Bombay or "), F.lower("region")))
    )
    rows = places(spark, d).select("ord", cell.alias("city"))
    return joins.geocode(rows, nations(spark, d)).select("ord", "display_city", "lon", "lat")


@query(
    "e4_geocode_names",
    f"""with gz as (select n_nationkey as g, n_name, 'country ' || n_nationkey as country, {NATION_AT} from nation),
    n as (select distinct case when ord % 2 = 0 then place_name else upper(place_name) || ' ' end as name from places)
    select name, lon, lat, country, 0.8::double as geo_confidence, false as is_historical from n join gz on lower(n_name) = lower(trim(name))""",
)
def _(spark, d):
    name = F.when(F.col("ord") % 2 == 0, F.col("place_name")).otherwise(F.concat(F.upper("place_name"), F.lit(" ")))
    names = places(spark, d).select(name.alias("name")).distinct()
    return joins.geocode_names(names, nations(spark, d)).drop("modern_name")


# ---- E5: nearest of the seed cities ----

_SEEDS = "(values " + ", ".join(f"({i}, '{r[0]}', {r[1]}::double, {r[2]}::double)" for i, r in enumerate(vocab.SEED_CITIES)) + ") s(i, city, clon, clat)"


def _sql_distance(lon1, lat1, lon2, lat2, r):
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * {r} * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0)))"


@query(
    "e5_nearest_city",
    f"""with x as (select ord, city, {_sql_distance('lon', 'lat', 'clon', 'clat', '6371.0')} as km, i from places, {_SEEDS}),
    r as (select *, row_number() over (partition by ord order by km, i) as rank from x) select ord, city, round(km, 2) as km from r where rank = 1""",
)
def _(spark, d):
    near = places(spark, d).withColumn("n", spatial.nearest_seed_city("lon", "lat"))
    return near.select("ord", F.col("n.city").alias("city"), F.round("n.distance_km", 2).alias("km"))


@query(
    "e5_nearest_city_table",
    f"""with x as (select p.ord, c.ord as near_ord, c.place_name as near_place, {_sql_distance('p.lon', 'p.lat', 'c.lon', 'c.lat', '6371.0')} as km from places p, places c where c.ord % 20 = 0),
    r as (select *, row_number() over (partition by ord order by km, near_ord) as rank from x) select ord, near_ord, near_place, round(km, 2) as km from r where rank = 1""",
)
def _(spark, d):
    p = places(spark, d).select("ord", "place_name", "lon", "lat")
    near = spatial.nearest_city(p, p.filter("ord % 20 = 0"))
    return near.select("ord", "near_ord", F.col("near_place_name").alias("near_place"), F.round("near_km", 2).alias("km"))


# ---- E6 - E8: keys ----


@query("e6_select_keys", f"select ord, id from places where author in (select source from documents where lang = 'fr')")
def _(spark, d):
    keys = table(spark, d, "documents").filter("lang = 'fr'").select("source")
    return select_keys(places(spark, d), keys, "author").select("ord", "id")


_EXISTING = "list_contains(genres, 'crime')"


@query(
    "e7_append_new",
    f"""with e as (select ord, id, book_title, author from places where {_EXISTING}),
    i as (select ord + 100000 as ord, 'new-' || id as id, book_title, author, row_number() over (partition by {norm('book_title')}, {norm('author')} order by ord) as rank from places)
    select ord, id from e union all select ord, id from i where rank = 1 and ({norm('book_title')}, {norm('author')}) not in (select ({norm('book_title')}, {norm('author')}) from e)""",
)
def _(spark, d):
    p = places(spark, d)
    incoming = p.withColumns({"ord": F.col("ord") + 100000, "id": F.concat(F.lit("new-"), "id"), "book_title": F.concat(F.lit("  "), "book_title")})
    return append_new(p.filter(F.array_contains("genres", "crime")), incoming).select("ord", "id")


@query("e8_pending", "select ord || ':' || id as row_key from places where not list_contains(genres, 'poetry')")
def _(spark, d):
    rows = with_row_key(places(spark, d))
    return pending(rows, rows.filter(F.array_contains("genres", "poetry")), "row_key").select("row_key")


# ---- E9, E10, L9: points around suppliers ----

CENTRES_SQL = "select s_suppkey as centre_id, (s_suppkey * 7333 % 36000) / 100.0::double - 180 as clon, (s_suppkey * 3571 % 17900) / 100.0::double - 89.5 as clat from supplier"


def centres(spark, d):
    """Suppliers as query points, all over the globe and near both poles."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("centre_id"), ((k * 7333 % 36000) / F.lit(100.0) - 180).alias("centre_lon"),
        ((k * 3571 % 17900) / F.lit(100.0) - 89.5).alias("centre_lat"),
    )


_PAIR = _sql_distance("clon", "clat", "lon", "lat", "6371000.0")


@query(
    "e9_within_radius",
    f"with c as ({CENTRES_SQL}), x as (select centre_id, ord, {_PAIR} as m from places, c) select centre_id, ord, round(m, 1) as distance_m from x where m <= 700000",
)
def _(spark, d):
    pairs = spatial.within_radius(places(spark, d), centres(spark, d), 700_000)
    return pairs.select("centre_id", "ord", F.round("distance_m", 1).alias("distance_m"))


_NEARBY_SQL = f"""c as ({CENTRES_SQL}), x as (select centre_id, ord, id, lon, lat, {_PAIR} as m from places, c),
 n as (select *, count(*) filter (where m <= 700000) over (partition by centre_id) as hits, row_number() over (partition by centre_id order by m, ord) as rank from x)"""


@query(
    "e10_nearby",
    f"with {_NEARBY_SQL} select centre_id, ord, rank, round(m, 1) as distance_m, hits < 3 as fallback from n where rank <= 5 and (hits < 3 or m <= 700000)",
)
def _(spark, d):
    near = spatial.nearby(places(spark, d), centres(spark, d), 700_000, 5)
    return near.select("centre_id", "ord", "rank", F.round("distance_m", 1).alias("distance_m"), "fallback")


@query(
    "e10_near_point",
    f"""with x as (select ord, id, {_sql_distance('72.8777', '19.076', 'lon', 'lat', '6371000.0')} as m from places)
    select ord, id, round(m, 1) as distance_m, (select count(*) from x where m <= 2000000) < 3 as fallback from x
    where m <= 2000000 or (select count(*) from x where m <= 2000000) < 3 order by distance_m, ord limit 20""",
)
def _(spark, d):
    return spatial.near_point(places(spark, d), 72.8777, 19.076, 2_000_000, 20).select("ord", "id", "distance_m", "fallback")


@query(
    "l9_walking_tours",
    f"""with recursive {_NEARBY_SQL}, s as (select centre_id, id, lon as px, lat as py, m, row_number() over (partition by centre_id order by m, ord) as r, count(*) over (partition by centre_id) as size
      from n where rank <= 8 and m <= 700000),
    w as (select centre_id, 1 as stop, [r] as seen, id, px, py, m as leg, m as total from s where r = 1 and size >= 2
     union all select w.centre_id, w.stop + 1, list_append(w.seen, s.r), s.id, s.px, s.py, {_sql_distance('w.px', 'w.py', 's.px', 's.py', '6371000.0')} as leg, w.total + {_sql_distance('w.px', 'w.py', 's.px', 's.py', '6371000.0')}
      from w join s on s.centre_id = w.centre_id and not list_contains(w.seen, s.r)
      qualify row_number() over (partition by w.centre_id order by {_sql_distance('w.px', 'w.py', 's.px', 's.py', '6371000.0')}, s.r) = 1)
    select centre_id, stop, id, round(leg, 3) as leg_m, round(total, 3) as total_m from w""",
)
def _(spark, d):
    near = spatial.nearby(places(spark, d), centres(spark, d), 700_000, 8)
    tours = spatial.walking_tours(near, reach_m=700_000)
    return tours.withColumns({"leg_m": F.round("leg_m", 3), "total_m": F.round("total_m", 3)})


@query(
    "l4_grid_cells",
    "select ord, cast(floor((lon + 180) / 0.5) as bigint) as cx, cast(floor(lat / 0.5) as bigint) as cy from places",
)
def _(spark, d):
    from tomeatlas.functions.geo import grid_cell, wrapped_lon_cell

    return places(spark, d).select("ord", wrapped_lon_cell("lon", 0.5).alias("cx"), grid_cell("lat", 0.5).alias("cy"))


# ---- E11, E12 ----


@query(
    "e11_related_works",
    """with a as (select * from places where id = 'doc-43'), x as (select p.*, a.place_name as ap, a.region as ar, a.publish_year as ay, a.language as al,
      list_filter(p.genres, lambda g: list_contains(a.genres, g)) as sg, list_filter(p.themes, lambda t: list_contains(a.themes, t)) as st from places p, a where p.id <> a.id),
    s as (select *, case when place_name = ap then 3 else 0 end + case when region = ar and place_name <> ap then 1 else 0 end + 2 * len(sg) + 2 * len(st)
      + case when abs(publish_year - ay) < 20 then 1 else 0 end + case when language = al and al <> 'English' then 2 else 0 end as score from x)
    select ord, id, score, array_to_string(list_filter([case when place_name = ap then 'Same city' end, case when len(sg) > 0 then 'Shared: ' || array_to_string(sg[1:2], ', ') end,
      case when len(st) > 0 then 'Themes: ' || replace(array_to_string(st[1:2], ', '), '_', ' ') end, case when abs(publish_year - ay) < 20 then 'Similar era' end,
      case when language = al and al <> 'English' then 'Both in ' || language end], lambda r: r is not null)[1:2], '; ') as reasons from s where score >= 3 order by score desc, ord limit 8""",
)
def _(spark, d):
    r = profiles.related_works(places(spark, d), "doc-43")
    return r.select("ord", "id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "e11_related_works_set",
    """with a as (select * from places where ord % 20 = 0), x as (select p.*, a.id as aid, a.place_name as ap, a.region as ar, a.publish_year as ay, a.language as al,
      list_filter(p.genres, lambda g: list_contains(a.genres, g)) as sg, list_filter(p.themes, lambda t: list_contains(a.themes, t)) as st from places p, a where p.id <> a.id),
    s as (select *, case when place_name = ap then 3 else 0 end + case when region = ar and place_name <> ap then 1 else 0 end + 2 * len(sg) + 2 * len(st)
      + case when abs(publish_year - ay) < 20 then 1 else 0 end + case when language = al and al <> 'English' then 2 else 0 end as score from x),
    r as (select *, row_number() over (partition by aid order by score desc, ord) as rank from s where score >= 3)
    select aid as query_id, rank, ord, id, score, array_to_string(list_filter([case when place_name = ap then 'Same city' end, case when len(sg) > 0 then 'Shared: ' || array_to_string(sg[1:2], ', ') end,
      case when len(st) > 0 then 'Themes: ' || replace(array_to_string(st[1:2], ', '), '_', ' ') end, case when abs(publish_year - ay) < 20 then 'Similar era' end,
      case when language = al and al <> 'English' then 'Both in ' || language end], lambda r: r is not null)[1:2], '; ') as reasons from r where rank <= 8""",
)
def _(spark, d):
    p = places(spark, d)
    r = profiles.related_works_of(p, p.filter("ord % 20 = 0").select("id"))
    return r.select("query_id", "rank", "ord", "id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "e12_author_connections",
    """with t as (select author, count(*) as book_count from places group by 1), u as (select author, lon, lat, min(ord) as ord, arg_min(place_name, ord) as place_name from places group by 1, 2, 3)
    select a.author, a.place_name as source_city, b.place_name as target_city, a.ord as source_ord, b.ord as target_ord, book_count from u a join u b on a.author = b.author and a.ord < b.ord join t on t.author = a.author where a.author in (select author from t order by book_count desc, author limit 1) or a.author in (select author from places where ord % 20 = 0)""",
)
def _(spark, d):
    # the author with most entries, and those of a stated set of rows
    p = places(spark, d)
    first = p.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(1).select("author")
    asked = first.unionByName(p.filter("ord % 20 = 0").select("author"))
    # small buckets, so that the pairing of buckets is used here as well
    return profiles.author_connections(p, asked, bucket=16).select(
        "author", "source_city", "target_city", "source_ord", "target_ord", "book_count"
    )


@query(
    "e12_connection_counts",
    """with t as (select author, count(*) as book_count from places group by 1), u as (select author, count(*) as places from (select distinct author, lon, lat from places) group by 1)
    select author, book_count, u.places as places, cast(u.places * (u.places - 1) // 2 as bigint) as connections from t join u using (author)""",
)
def _(spark, d):
    return profiles.connection_counts(places(spark, d))


# ---- E13 - E15 ----


@query(
    "e13_resolve_labels",
    """with r as (select *, case when ord % 4 = 0 then 'Q' || ord else book_title end as t from places)
    select ord, case when ord % 4 = 0 and list_contains(genres, 'crime') then 'label ' || ord else t end as title from r
    where not (ord % 4 = 0 and not list_contains(genres, 'crime'))""",
)
def _(spark, d):
    qid = F.concat(F.lit("Q"), F.col("ord").cast("string"))
    p = places(spark, d)
    rows = p.withColumns({"book_title": F.when(F.col("ord") % 4 == 0, qid).otherwise(F.col("book_title")), "source": F.lit("wikidata")})
    labels = p.filter(F.array_contains("genres", "crime")).select(qid.alias("qid"), F.concat(F.lit("label "), F.col("ord").cast("string")).alias("label"))
    return joins.resolve_labels(rows, labels, drop=True).select("ord", F.col("book_title").alias("title"))


@query(
    "e14_merge_genres",
    """with k as (select *, 'OL' || (ord % 5) as key from places),
    add as (select 'OL0' as key, ['gothic fiction', 'mystery'] as added union all select 'OL1', ['crime fiction'] union all select 'OL2', [])
    select ord, array_to_string(case when len(added) > 0 then list_concat(genres, list_filter(added, lambda g: not list_contains(genres, g)))[1:8] else genres end, '|') as genres from k left join add using (key)""",
)
def _(spark, d):
    rows = places(spark, d).withColumn("open_library_key", F.concat(F.lit("OL"), (F.col("ord") % 5).cast("string")))
    subjects = spark.createDataFrame(
        [("OL0", ["Gothic tales", "Fiction", "Mystery stories"]), ("OL1", ["True crime"]), ("OL2", ["Fiction"])],
        "open_library_key string, subjects array<string>",
    )
    return joins.merge_genres(rows, subjects).select("ord", joined("genres").alias("genres"))


@query(
    "e15_apply_enrichment",
    f"""select ord, case when list_contains(genres, 'crime') then -0.25::double else polarity end as polarity, case when list_contains(genres, 'crime') then 'war_trauma' else array_to_string(themes, '|') end as themes,
     case when list_contains(genres, 'crime') then case when {strip('passage')} <> '' then 'gemini_passage' else 'gemini_reputation' end end as enrichment_method,
     case when list_contains(genres, 'crime') then 'm1' end as model from places""",
)
def _(spark, d):
    rows = with_row_key(places(spark, d))
    results = rows.filter(F.array_contains("genres", "crime")).select(
        "row_key", F.lit(-0.25).alias("polarity"), "emotions", F.array(F.lit("war_trauma")).alias("themes"), F.lit("quiet").alias("literary_mood")
    )
    out = joins.apply_enrichment(rows, results, "m1")
    return out.select("ord", "polarity", joined("themes").alias("themes"), "enrichment_method", F.col("enriched_by_model").alias("model"))


# ---- E16: composite places ----

_SPLITS = _SPLIT.format(x="place_name")
SPLIT_SQL = f"""ref as (select {norm('place_name')} as k, avg(lon) as rlon, avg(lat) as rlat from base where {GRANULARITY_SQL} = 'city' group by 1),
 tagged as (select *, case when {COMPOSITE_SQL} then {sql_ordered_distinct(f"[trim(p, ' ,.-') for p in {_SPLITS}]")} end as parts from base),
 ex as (select *, unnest(parts) as part, generate_subscripts(parts, 1) as pos from tagged where len(parts) > 1),
 split as (select * exclude (parts) replace (place_name as place_name), 0 as pos, 'plain' as split_status from tagged where coalesce(len(parts), 0) <= 1
  union all by name select ex.* exclude (parts, part, pos, id, place_name, lon, lat), id || '::p' || pos as id, part as place_name, coalesce(round(rlon, 6), lon) as lon, coalesce(round(rlat, 6), lat) as lat,
   pos, case when rlon is null then 'unresolved' else 'resolved' end as split_status from ex left join ref on k = {norm('part')})"""
# some composites name a place that occurs nowhere else
COMPOSED_SQL = "select * replace (case when ord % 22 = 0 then place_name || '; Elsewhere ' || (ord % 3) else place_name end as place_name) from places"


def composed(spark, d):
    more = F.concat("place_name", F.lit("; Elsewhere "), (F.col("ord") % 3).cast("string"))
    return places(spark, d).withColumn("place_name", F.when(F.col("ord") % 22 == 0, more).otherwise(F.col("place_name")))


@query(
    "e16_split_composites",
    f"with base as ({COMPOSED_SQL}), {SPLIT_SQL} select id, place_name, round(lon, 4) as lon, round(lat, 4) as lat, split_status from split",
)
def _(spark, d):
    s = joins.split_composites(composed(spark, d))
    return s.select("id", "place_name", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "split_status")


# ---- M: vectors ----

_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(
    "m1_nearest_vectors",
    f"""with x as (select a.vec_id as ord, b.vec_id as other, {_COS} as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by ord order by score desc, other) as rank from x where score > 0.4) select ord, rank, other, round(score, 4) as score from r where rank <= 6""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    # several blocks and parts, so that their meeting is used here as well
    near = vectors.nearest_vectors(v.filter("ord % 20 = 0"), v, query_rows=20, part_rows=200)
    return near.select("ord", "rank", "other", F.round("score", 4).alias("score"))


def embedded_books(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    return profiles.books_from_entries(places(spark, d)).join(v, "ord")


SIMILAR_SQL = f"""with b as (select book_title, author, min(ord) as ord, list_sort(list_distinct(flatten(list(themes)))) as themes from places group by 1, 2),
    e as materialized (select b.*, embedding from b join embeddings on vec_id = ord),
    x as materialized (select a.ord, b.ord as other, {_COS} as score from e a join e b on a.ord <> b.ord where a.ord % 20 = 0),
    r as materialized (select *, row_number() over (partition by ord order by score desc, other) as rank from x where score > 0.4)
    select r.ord, a.book_title, b.book_title as similar_title, rank, round(score, 3) as score, array_to_string(list_sort(list_intersect(a.themes, b.themes))[1:2], '|') as shared_themes
    from r join e a on a.ord = r.ord join e b on b.ord = other where rank <= 6"""


@query("m1_indexed_neighbours")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    centres = vector_index.fit_centroids(v)
    index = vector_index.vector_index(v, centres)
    near = vector_index.indexed_neighbours(v, index, centres, vector_index.probes_for(v, index, centres))
    return near.select("ord", "rank", "other", F.round("score", 4).alias("score"))


@query("m1_similar_works", SIMILAR_SQL)
def _(spark, d):
    books = embedded_books(spark, d)
    s = vectors.similar_works(books.filter("ord % 20 = 0"), books)
    return s.select("ord", "book_title", "similar_title", "rank", "score", joined("shared_themes").alias("shared_themes"))


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::double" for x in QUERY_VECTOR) + "]"


@query(
    "m2_semantic_search",
    f"""with x as (select vec_id as ord, book_title, place_name, list_cosine_similarity(embedding::double[], {_Q}) as s from embeddings join places on vec_id = ord)
    select ord, book_title, place_name, round(s, 4) as similarity from x where s > 0.1 order by s desc, ord limit 10""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    found = vectors.semantic_search(v, QUERY_VECTOR, 10, 0.1)
    return found.join(places(spark, d), "ord").select("ord", "book_title", "place_name", F.round("similarity", 4).alias("similarity"))


@query(
    "m3_hybrid_search",
    f"""with x as (select ord, list_cosine_similarity(embedding::double[], {_Q}) as s, {_sql_distance('72.8777', '19.076', 'lon', 'lat', '6371000.0')} as m from embeddings join places on vec_id = ord)
    select ord, round(m, 1) as distance_m, round(s, 4) as similarity, round(0.6 * s + 0.4 * (1 - least(m / 6000000, 1)), 4) as combined_score from x where m <= 6000000 order by 0.6 * s + 0.4 * (1 - least(m / 6000000, 1)) desc, ord limit 20""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")
    found = vectors.hybrid_search(places(spark, d).join(v, "ord"), QUERY_VECTOR, 72.8777, 19.076, 6_000_000, 20)
    return found.select("ord", *[F.round(c, n).alias(c) for c, n in (("distance_m", 1), ("similarity", 4), ("combined_score", 4))])


