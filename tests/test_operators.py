import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_quality import rows
from tomeatlas import vocab
from tomeatlas.operators import dedup, extract, joins, profiles, search, select, spatial, vectors
from tomeatlas.plans.cleanup import run_cleanup
from tomeatlas.plans.ingest import expansion_status
from tomeatlas.sources.parsers import parse_narrative_bindings


def metres(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


@pytest.fixture(scope="module")
def globe(spark):
    rng = random.Random(7)
    pts = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(400)]
    pts += [(180.0, 10.0), (-180.0, 10.0), (179.95, 10.0), (-179.95, 10.0), (0.0, 90.0), (12.0, -90.0), (50.0, 89.9), (-130.0, 89.9)]
    pts += [(20.0, 20.0)] * 150  # a crowded coordinate
    centres = [(179.99, 10.0), (-179.99, 10.01), (0.0, 89.95), (100.0, -89.99), (20.0, 20.0), (20.3, 20.1), (-60.0, -40.0), (5.0, 0.0)]
    centres += [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(12)]
    p = spark.createDataFrame([(i, f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)], "ord bigint, id string, lon double, lat double")
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], "centre_id bigint, centre_lon double, centre_lat double")
    return pts, centres, p, c


@pytest.mark.parametrize("radius", [900.0, 60_000.0, 2_500_000.0, 12_000_000.0])
def test_radius_join_equals_brute_force(globe, radius):
    pts, centres, p, c = globe
    got = {(r["centre_id"], r["ord"]) for r in spatial.within_radius(p, c, radius).select("centre_id", "ord").collect()}
    want = {(i, j) for i, a in enumerate(centres) for j, b in enumerate(pts) if metres(a, b) <= radius}
    assert got == want


@pytest.mark.parametrize("k", [1, 4, 300])
def test_knn_equals_brute_force(globe, k):
    pts, centres, p, c = globe
    got = {}
    for r in spatial.knn(p, c, k).select("centre_id", "rank", "ord", "distance_m").collect():
        got.setdefault(r["centre_id"], []).append((r["rank"], r["ord"], r["distance_m"]))
    for i, a in enumerate(centres):
        want = sorted((metres(a, b), j) for j, b in enumerate(pts))[:k]
        mine = sorted(got[i])
        assert len(mine) == min(k, len(pts))
        assert [m for _, _, m in mine] == pytest.approx([m for m, _ in want], rel=1e-9, abs=1e-3)


def test_nearby_falls_back_below_three_hits(spark):
    pts = [(0.0, 0.0), (0.0, 0.1), (0.0, 0.2), (50.0, 0.0), (50.0, 0.1), (90.0, 1.0)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "ord bigint, lon double, lat double")
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "centre_id bigint, centre_lon double, centre_lat double")
    got = spatial.nearby(p, c, 50_000, 4).orderBy("centre_id", "rank").collect()
    assert [(r["centre_id"], r["ord"], r["fallback"]) for r in got if r["centre_id"] == 1] == [(1, 0, False), (1, 1, False), (1, 2, False)]
    assert [(r["ord"], r["fallback"]) for r in got if r["centre_id"] == 2] == [(3, True), (4, True), (5, True), (0, True)]
    for lon, lat, n, fallback in ((0.0, 0.0, 3, False), (50.0, 0.0, 6, True)):
        near = spatial.near_point(p, lon, lat, 50_000, 20).collect()
        assert len(near) == n and {r["fallback"] for r in near} == {fallback}


def test_box_keeps_every_hit(globe):
    pts, centres, p, _ = globe
    for a in centres:
        for radius in (60_000.0, 3_000_000.0):
            kept = {r["ord"] for r in p.filter(spatial.in_box(a[0], a[1], radius)).select("ord").collect()}
            assert {j for j, b in enumerate(pts) if metres(a, b) <= radius} <= kept


def test_walking_tour(spark):
    near = spark.createDataFrame(
        [(1, "a", 0.0, 0.010, 1112.0, 0), (1, "b", 0.0, 0.030, 3336.0, 1), (1, "c", 0.0, 0.012, 1334.0, 2), (1, "far", 0.0, 0.9, 90_000.0, 3), (2, "x", 0.0, 0.0, 1.0, 4)],
        "centre_id bigint, id string, lon double, lat double, distance_m double, ord bigint",
    )
    tour = spatial.walking_tours(near).orderBy("stop").collect()
    assert [(r["centre_id"], r["id"]) for r in tour] == [(1, "a"), (1, "c"), (1, "b")]
    assert tour[-1]["total_m"] == pytest.approx(1112 + 222.4 + 2001.5, abs=1)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8))
    v[50:60] = v[0]  # copies
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "ord bigint, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    for size in (16, 1000):
        got = {}
        for r in vectors.nearest_vectors(df, df, 6, 0.4, query_rows=size, part_rows=2 * size).collect():
            got.setdefault(r["ord"], []).append((r["rank"], r["score"]))
        for i in range(len(v)):
            want = sorted((s[i, j] for j in range(len(v)) if j != i and s[i, j] > 0.4), reverse=True)[:6]
            assert [x for _, x in sorted(got.get(i, []))] == pytest.approx(want)


def test_author_pairs_equal_brute_force(spark):
    records = [dict(author="Unknown" if i % 3 else "b", place_name=f"p{i % 40}", lon=float(i % 40), lat=1.0) for i in range(120)]
    df = rows(spark, *records)
    for bucket in (4, 1000):
        got = profiles.author_connections(df, ["Unknown", "b"], bucket)
        pairs = [(r["author"], r["source_ord"], r["target_ord"]) for r in got.collect()]
        firsts = {}
        for i, r in enumerate(records):
            firsts.setdefault((r["author"], r["lon"]), i)
        want = {(a, i, j) for (a, _), i in firsts.items() for (b, _), j in firsts.items() if a == b and i < j}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_dedup_keeps_everything_once(spark):
    df = rows(
        spark,
        dict(book_title="A  b", author="X", place_name="Oslo", themes=["t"]), dict(book_title="a B", author="x", place_name="oslo ", themes=["t"]),
        dict(book_title="A b", author="X", place_name="Oslo", themes=["t"], cover_url="u"), dict(book_title="c", author="X", place_name="Oslo"),
    )
    kept, removed = dedup.dedup_best(df)
    assert sorted(r["ord"] for r in kept.collect()) == [2, 3]
    assert sorted(r["ord"] for r in removed.collect()) == [0, 1]
    again, nothing = dedup.dedup_best(kept)
    assert again.count() == 2 and nothing.count() == 0


def test_top_k_with_salts(spark):
    df = spark.range(5000).withColumns({"g": F.lit("hot"), "v": F.pmod(F.xxhash64("id"), F.lit(1_000_000))})
    got = [r["v"] for r in dedup.top_k_per_group(df, ["g"], [F.col("v").desc(), "id"], 1500).orderBy("rank").collect()]
    assert got == sorted((r["v"] for r in df.collect()), reverse=True)[:1500]


def test_years_and_filters(spark):
    df = rows(spark, *[dict(publish_year=y, language=lang) for y, lang in ((0, "x"), (None, ""), (1899, None), (1900, "y"), (2000, "y"))])

    def got(d):
        return sorted(r["ord"] for r in d.collect())

    assert got(search.filter_years(df, 0, 0)) == [0, 1, 2, 3, 4]
    assert got(search.filter_years(df, 1900, None)) == [3, 4]
    assert got(search.filter_years(df, None, 1950)) == [2, 3]
    assert got(search.filter_facets(df, languages=["Unknown"])) == [1, 2]
    assert got(search.filter_facets(df, eras=["Pre-1900"])) == [0, 1, 2]


def test_composites_in_strict_and_lenient_mode(spark):
    df = rows(
        spark, dict(id="a", book_title="t", place_name="Paris", lon=2.0, lat=48.0), dict(id="b", book_title="t", place_name="Paris", lon=3.0, lat=49.0),
        dict(id="c", book_title="u", place_name="Paris and Atlantis", lon=9.0, lat=9.0), dict(id="", book_title="v", place_name="Paris; paris / Paris", lon=9.0, lat=9.0),
    )
    kept, removed = joins.explode_composites(df)
    by_id = {r["id"]: r for r in kept.collect()}
    assert by_id["c::p1"]["lon"] == 2.5 and by_id["c::p1"]["coordinate_confidence"] == 0.8
    assert "composite::2::paris" in by_id  # "Paris" and "paris" are two spellings
    assert sorted((r["id"], r["place_name"]) for r in removed.collect()) == [("c", "Paris and Atlantis"), ("c::p2", "Atlantis")]
    loose, none = joins.explode_composites(df, drop_unresolved=False)
    assert loose.count() == kept.count() + 1 and none.count() == 0


def test_cleanup_accounts_for_every_row(spark):
    df = rows(
        spark, dict(book_title="Field Guide to Oslo", place_name="Oslo"), dict(book_title="Q12", place_name="Oslo"), dict(book_title="Dubliners", place_name="Paris"),
        dict(book_title="Nice", author="a", place_name="Oslo", lon=1.0, lat=1.0), dict(book_title="nice", author="A", place_name="oslo", lon=1.0, lat=1.0),
    )
    out = run_cleanup(df)
    assert sorted(r["reason"] for r in out["removed"].collect()) == ["ambiguous_title", "duplicate_title_author_place", "nonfiction_title", "title_city_mismatch"]
    data = out["data"].collect()
    assert [r["ord"] for r in data] == [3] and data[0]["passage_type"] == "none" and data[0]["coordinate_source"] == "dataset"


def test_geocode_order(spark):
    gaz = spark.createDataFrame([(0, "Oslo", 1.0, 1.0), (1, "Greater Oslo", 2.0, 2.0), (2, "Rome", 3.0, 3.0)], "ord bigint, name string, lon double, lat double")
    cells = spark.createDataFrame([("Greater Oslo",), ("the greater oslo area",), ("chromed",), ("Nowhere",), ("Rome",)], "city string")
    got = {r["city"]: r["lon"] for r in joins.geocode(cells, gaz).collect()}
    assert got == {"Greater Oslo": 2.0, "the greater oslo area": 1.0, "chromed": 3.0, "Nowhere": None, "Rome": 3.0}


def test_merge_passages(spark):
    base = rows(spark, dict(id="a", passage="x" * 10), dict(id="b", passage="y" * 70), dict(id="c", passage="z" * 90), dict(id="b", passage=""))
    one = rows(spark, dict(id="a", passage="s" * 61), dict(id="b", passage="t" * 80), dict(id="c", passage="u" * 59))
    two = rows(spark, dict(id="a", passage="v" * 61), dict(id="c", passage="w" * 60))
    got = {r["ord"]: (r["passage"][:1], r["passage_source"], r["merge_status"]) for r in joins.merge_passages(base, [("openlibrary", one), ("wikipedia", two)]).collect()}
    assert got == {0: ("s", "openlibrary", "new"), 1: ("t", "openlibrary", "upgraded"), 2: ("w", "wikipedia", "replaced"), 3: ("t", "openlibrary", "new")}


def test_graph_pair_is_seen_before_its_coordinate(spark):
    b = '{"book":{"value":"http://e/Q1"},"place":{"value":"http://e/Q2"},"coord":{"value":"%s"}}'
    df = spark.createDataFrame([(0, b % "Point(bad)"), (1, b % "Point(1 2)"), (2, b.replace("Q2", "Q3") % "Point(1 2)")], "ord bigint, binding string")
    assert [r["ord"] for r in parse_narrative_bindings(df).collect()] == [2]


def test_rejected_rows_do_not_block_their_work(spark):
    existing = rows(spark, dict(book_title="Known", author="A"))
    new = [("Known", "a", 5.0), ("New", "A", 0.0), ("New", "A", 5.0), ("new", "a", 6.0)]
    df = spark.createDataFrame([(i, t, a, x, x) for i, (t, a, x) in enumerate(new)], "ord bigint, book_label string, author_label string, longitude double, latitude double")
    got = {r["ord"]: r["status"] for r in expansion_status(existing, df).collect()}
    assert got == {0: "deduped", 1: "rejected", 2: "new", 3: "deduped"}


def test_related_works(spark):
    df = rows(
        spark, dict(id="me", place_name="Oslo", region="Europe", genres=["crime"], themes=["war_trauma"], publish_year=1990, language="nb"),
        dict(id="twin", place_name="Oslo", region="Europe", genres=["crime"], themes=["war_trauma"], publish_year=2005, language="nb"),
        dict(id="near", place_name="Bergen", region="Europe", genres=[], themes=[], publish_year=1991, language="nb"),
        dict(id="far", place_name="Lima", region="South", genres=[], themes=[], publish_year=1991, language="es"),
    )
    got = [(r["id"], r["score"], r["reasons"]) for r in profiles.related_works(df, "me").collect()]
    assert got == [("twin", 10, ["Same city", "Shared: crime"]), ("near", 4, ["Similar era", "Both in nb"])]
    assert profiles.related_works(df, "nobody").count() == 0


# ---- selection ----


def slow_quotas(sizes, limit):
    """Quotas dealt one by one, round after round."""
    regions = sorted(sizes)
    total, target = sum(sizes.values()), min(limit, sum(sizes.values()))
    s = sum(math.sqrt(sizes[r] / total) for r in regions)
    q = {r: min(max(15, int(limit * (math.sqrt(sizes[r] / total) / max(s, 1e-9)))), sizes[r]) for r in regions}
    for floor in (15, 0):
        order = sorted(regions, key=lambda r: -q[r])
        while sum(q.values()) > target and any(q[r] > floor for r in order):
            for r in order:
                if q[r] > floor and sum(q.values()) > target:
                    q[r] -= 1
    order = sorted(regions, key=lambda r: -(sizes[r] - q[r]))
    while sum(q.values()) < target:
        for r in order:
            if q[r] < sizes[r] and sum(q.values()) < target:
                q[r] += 1
    return q


@pytest.mark.parametrize("limit", [0, 7, 40, 100, 333, 5000])
def test_quotas(limit):
    for sizes in ({"a": 500, "b": 40, "c": 3}, {"a": 10, "b": 12}, {chr(97 + i): 30 + i for i in range(12)}):
        got = select.allocate(pd.Series(sizes), limit)
        assert got.to_dict() == slow_quotas(sizes, limit)
        assert got.sum() == min(limit, sum(sizes.values()))


def slow_selection(rows_, quotas):
    """Greedy choice over whole pools."""
    regions, countries, spots, out = {}, {}, {}, []
    for r in sorted(quotas):
        pool = sorted((x for x in rows_ if x["region"] == r), key=lambda x: (-x["base_score"], x["ord"]))
        budget = quotas[r]
        for _ in range(budget):
            head = pool[: max(budget * 6, 400)]
            score = [x["base_score"] + 0.22 / (1 + regions.get(r, 0)) + 0.12 / (1 + countries.get(x["country"], 0)) + 0.10 / (1 + spots.get(x["place_name"], 0)) for x in head]
            x = pool.pop(max(range(len(head)), key=lambda i: (score[i], -i)))
            out.append(x["ord"])
            regions[r] = regions.get(r, 0) + 1
            countries[x["country"]] = countries.get(x["country"], 0) + 1
            spots[x["place_name"]] = spots.get(x["place_name"], 0) + 1
    return out


def test_selection_equals_slow_one(spark):
    rng = random.Random(5)
    records = [
        dict(book_title=f"t{rng.randrange(300)}", author=f"a{rng.randrange(20)}", region=rng.choice(["E", "E", "E", "W", "S"]), country=f"c{rng.randrange(6)}",
             place_name=f"p{rng.randrange(30)}", passage="x" if rng.random() < 0.5 else "")
        for _ in range(900)
    ]
    df = rows(spark, *records)
    editions = dedup.with_book_key(df).select("title_key", "author_key").distinct().withColumn("edition_count", F.pmod(F.xxhash64("title_key"), F.lit(40)))
    scored = select.enrichment_score(df, editions)
    data = [r.asDict() for r in scored.select("ord", "region", "country", "place_name", "base_score").collect()]
    sizes = {r: sum(x["region"] == r for x in data) for r in ("E", "W", "S")}
    want = slow_selection(data, slow_quotas(sizes, 120))
    got = [r["ord"] for r in select.select_diverse(scored, 120).orderBy("pick").collect()]
    assert got == want


# ---- text ----


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "In New York, (rome) and Rome. NEW YORK! Chrome new"), (2, None), (3, "york new")], "doc_id bigint, text string")
    gaz = spark.createDataFrame([("Rome",), ("New York",), ("x",)], "name string")
    got = {(r["doc_id"], r["name_key"]): (r["mention"], r["first_word"], r["start_char"], r["end_char"], r["frequency"], r["confidence"]) for r in extract.extract_mentions(docs, gaz).collect()}
    assert got == {(1, "new york"): ("New York", 2, 3, 11, 2, 0.95), (1, "rome"): ("rome", 4, 14, 18, 2, 0.8)}


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_occurrences_against_brute_force(spark, bits):
    """Overlapping, nested and repeated names; blanks of any kind; a table so small that it lets nearly everything through."""
    rng = random.Random(4)
    names = ["new", "new york", "new york city", "york", "city hall", "San  Marino", "zz", "Ünder", "", " ", "x"]
    parts = ["New", "york", "(York", "CITY.", "hall", "san", "Marino!", "zz", "--", "under", "\u00dcNDER,", "x"]
    texts = [None, "", "   ", "new", "\n new  york\tcity"] + ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n\n", "\u00a0", "\u2003 "]) for _ in range(200)) for _ in range(20)]
    wanted = {" ".join(n.lower().split()) for n in names}
    want = []
    for i, s in enumerate(texts):
        words = [(m.start(), m.group()) for m in re.finditer(r"\S+", s or "")]
        words = [(a + len(w) - len(w.lstrip(extract.EDGE_MARKS)), w.strip(extract.EDGE_MARKS)) for a, w in words]
        shift = 2 if (s or "")[:1].isspace() else 1
        for a in range(len(words)):
            for n in (1, 2, 3):
                run = words[a : a + n]
                surface = " ".join(w for _, w in run)
                if len(run) == n and len(surface) > 1 and all(w for _, w in run) and surface.lower() in wanted:
                    want.append((i, surface.lower(), surface, a + shift, run[0][0], run[-1][0] + len(run[-1][1])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = extract.occurrences(docs, spark.createDataFrame([(n,) for n in names] + [(None,), ("New York",)], "name string"), bits)
    assert sorted(tuple(r) for r in found.select("doc_id", "name_key", "surface", "word", "start_char", "end_char").collect()) == sorted(want) and want
    none = extract.occurrences(docs, spark.createDataFrame([], "name string"), bits)
    assert none.count() == 0 and extract.occurrences(docs.limit(0), spark.createDataFrame([("zz",)], "name string"), bits).count() == 0


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    texts = ["", "short", "x" * 5000, " ".join("word" * rng.randrange(1, 4) + rng.choice(["", ".", "\n", "\n\n"]) for _ in range(2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for size, overlap in ((200, 20), (50, 50), (2000, 200)):
        out = extract.chunk_text(docs, size, overlap).orderBy("doc_id", "chunk").collect()
        for i, s in enumerate(texts):
            spans = [(r["start_char"], r["end_char"]) for r in out if r["doc_id"] == i]
            assert all(s[r["start_char"] : r["end_char"]] == r["text"] for r in out if r["doc_id"] == i)
            assert not s or (spans[0][0] == 0 and spans[-1][1] == len(s))
            assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))


def test_context_windows(spark):
    s = "First one here. " + "a" * 200 + ". We walked through Rome at night, all of us! " + "b" * 200 + ". rome. The end"
    docs = spark.createDataFrame([(1, s)], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "rome", "Rome")], "doc_id bigint, name_key string, mention string")
    got = [r["passage"] for r in extract.context_windows(docs, names, width=10).orderBy("passage_no").collect()]
    assert got[0] == "We walked through Rome at night, all of us!"


def test_inference_keeps_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "ord bigint, passage string").repartition(2)

    def broken(batch):
        raise RuntimeError("no answer")

    got = extract.infer(df, broken).collect()
    assert len(got) == 10 and {(r["status"], r["reason"]) for r in got} == {("failed", "exception: no answer")}


def test_vocabulary_lists_have_no_repeats():
    for name in dir(vocab):
        values = getattr(vocab, name)
        if isinstance(values, list) and name != "VAGUE_PLACES" and values and isinstance(values[0], str):
            assert len(values) == len(set(values)), name
