"""Fuzzy join of many queries and the vector index against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_flows import SMALL, _plan


def grams(s):
    import re

    words = [w for w in re.split(r"[^\w]+|_+", (s or "").lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def best_rows(rows, queries, k, threshold):
    out = {}
    for q, text in queries:
        found = []
        for ord_, *names in rows:
            r = max(len(grams(text) & grams(n)) / max(1, len(grams(text) | grams(n))) for n in names)
            if r >= threshold:
                found.append((-r, ord_))
        for rank, (r, ord_) in enumerate(sorted(found)[:k], 1):
            out[q, rank] = (ord_, round(-r, 9))
    return out


@pytest.mark.parametrize("k, threshold", [(3, 0.3), (50, 0.5), (5, 0.05), (4, 1.0)])
def test_fuzzy_join(spark, k, threshold):
    from tomeatlas.operators.fuzzy import fuzzy_join

    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    name = lambda: " ".join(word() for _ in range(rng.randrange(1, 4)))
    rows = [(i, name(), "Hot Author" if i % 3 else name(), rng.choice(["Delhi", "New Delhi", "", None])) for i in range(120)]
    rows.append((500, None, "!!", "Été à Paris"))
    queries = [(i, rows[i][1]) for i in range(0, 120, 20)] + [(900, "delhi"), (901, "hot autor"), (902, ""), (903, None), (904, "ÉTÉ"), (905, "delhi"), (906, "?")]
    df = spark.createDataFrame(rows, "ord long, book_title string, author string, place_name string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r.rank): (r.ord, round(r.match_rank, 9)) for r in fuzzy_join(df, asked, k, threshold).collect()}
    assert got == best_rows(rows, queries, k, threshold)
    assert fuzzy_join(df.where("false"), asked).count() == 0 and fuzzy_join(df, asked.where("false")).count() == 0


def test_fuzzy_join_makes_no_product(spark):
    from __spark_entry__ import queries
    from tomeatlas.operators.fuzzy import similar_strings

    assert "CartesianProduct" not in (plan := _plan(queries()["k6_fuzzy_join"](spark, SMALL))) and "NestedLoop" not in plan
    names = spark.createDataFrame([("abc",), ("abx",), ("zzz",)], "value string")
    pairs = {(r.query, r.value) for r in similar_strings(names, names, 0.3).collect()}
    assert pairs == {(a, b) for a in ("abc", "abx") for b in ("abc", "abx")} | {("zzz", "zzz")}


def test_fuzzy_join_counts_by_blocks_and_sends_few_pairs(spark, monkeypatch):
    """Null comes first, two rows may share an ord; a query that resembles all names brings few pairs, and no trigram is joined on."""
    from tomeatlas.operators import fuzzy

    monkeypatch.setattr(fuzzy, "BLOCK_ROWS", (2, 3))
    monkeypatch.setattr(fuzzy, "PART_ROWS", (5, 20))
    monkeypatch.setattr(fuzzy, "GATHERED", 30)
    rng = random.Random(3)
    rows = [(None if i == 77 else i, f"old town {i % 40}", "Old Town", rng.choice(["New Town", "𝒜𝒷𝒸 Town", f"town {i}", None])) for i in range(160)]
    queries = [(0, "old town 7"), (1, "old town"), (2, "𝒜𝒷𝒸 town"), (3, "town"), (4, "x" * 300 + "old town"), (5, " ".join(f"{i:03}" for i in range(400)))]
    rows += [(900, "x" * 200, None, " ".join(f"{i:03}" for i in range(390))), (900, "town of old", "old", None)]
    df = spark.createDataFrame(rows, "ord long, book_title string, author string, place_name string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    by_ord = defaultdict(list)
    for o, *names in rows:
        by_ord[-1 if o is None else o] += names
    for k in (2, 500):
        got = {(r.query_id, r.rank): (-1 if r.ord is None else r.ord, round(r.match_rank, 9)) for r in fuzzy.fuzzy_join(df, asked, k, 0.2).collect()}
        assert got == best_rows([(o, *names) for o, names in by_ord.items()], queries, k, 0.2)
    names = spark.createDataFrame([(i, f"old town {i:03}") for i in range(300)], "ord long, value string")
    pairs = fuzzy.similar_strings(asked.selectExpr("query as value"), names, 0.2, 2)
    assert "[gram" not in _plan(pairs) and "FlatMapGroupsInArrow" in _plan(pairs)
    assert pairs.where("query = 'old town'").count() == 2 and fuzzy.similar_strings(asked.selectExpr("query as value"), names, 0.2).where("query = 'old town'").count() == 300


@pytest.mark.parametrize("clustered", [False, True])
def test_vector_index_recall(spark, clustered):
    """Against the exact answer for the queries whose id is divisible by 20."""
    from tomeatlas.operators import vector_index as vi
    from tomeatlas.operators.vectors import nearest_vectors

    v = spark.read.parquet(f"{SMALL}/../sf0.01/embeddings.parquet").select(F.col("vec_id").alias("ord"), "embedding")
    if clustered:
        rng = np.random.default_rng(5)
        middle = rng.normal(size=(20, 16))
        v = spark.createDataFrame([(i, (middle[i % 20] + rng.normal(size=16) / 8).tolist()) for i in range(800)], "ord long, embedding array<double>")
    asked = v.where("ord % 20 = 0")
    exact = {(r.ord, r.other) for r in nearest_vectors(asked, v, floor=-2.0).collect()}
    centres = vi.fit_centroids(v)
    index = vi.vector_index(v, centres)
    assert index.count() == v.count() and 1 < len(centres) <= vi.MOST_LISTS
    probes = vi.probes_for(v, index, centres)
    assert not clustered or probes < len(centres) / 2
    got = {(r.ord, r.other) for r in vi.indexed_neighbours(asked, index, centres, probes, floor=-2.0).collect()}
    assert len(got & exact) >= 0.9 * len(exact) > 0, (len(got & exact), len(exact))
    every = {(r.ord, r.other) for r in vi.indexed_neighbours(asked, index, centres, len(centres), floor=-2.0, query_rows=5, part_rows=9).collect()}
    assert every == exact


def test_vector_index_of_a_hot_list_and_odd_rows(spark):
    from tomeatlas.operators import vector_index as vi

    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, float(x)]) for i, x in enumerate(rng.random(60) / 100)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [0.0, 1.0, 0.0])]
    v = spark.createDataFrame(rows, "ord long, embedding array<double>")
    centres = vi.fit_centroids(v, lists=3)
    near = vi.indexed_neighbours(v, vi.vector_index(v, centres), centres, 3, k=2, query_rows=7, part_rows=10)
    found = defaultdict(int)
    for r in near.collect():
        found[r.ord] += 1
    assert {i: found[i] for i in range(60)} == dict.fromkeys(range(60), 2) and not found[100] and not found[101] and not found[102]
    assert vi.indexed_neighbours(v.where("false"), vi.vector_index(v, centres), centres, 2).count() == 0
    assert len(vi.fit_centroids(v.where("false"))) == 1


def test_related_works_of_a_set(spark, monkeypatch):
    """Against the search for one entry, with copies, a hot city, repeated labels and few entries tried for the bound."""
    from tomeatlas.operators import profiles

    rng = random.Random(4)
    some = lambda xs, n: [rng.choice(xs) for _ in range(rng.randrange(n))]
    rows = []
    for i in range(150):
        city = "Hot" if i % 3 == 0 else rng.choice(["Delhi", "Pune", "", None])
        rows.append((i, f"e{i}", city, rng.choice(["Asia", "Europe", None]), some(["a", "b", "c", "d"], 4), some(["war_x", "y", "z", "u", "v"], 4) or None, rng.choice([0, 1900, 1915, 1990, None]), rng.choice(["English", "Hindi", None])))
    rows += [(200 + i, f"e{200 + i}", *rows[20][2:]) for i in range(30)]
    df = spark.createDataFrame(rows, "ord long, id string, place_name string, region string, genres array<string>, themes array<string>, publish_year int, language string").repartition(3).cache()
    ids = ["e0", "e20", "e47", "e205", "missing", None]
    asked = spark.createDataFrame([(i,) for i in [*ids, "e0"]], "id string")
    for tried, k in ((64, 8), (2, 3)):
        monkeypatch.setattr(profiles, "TRIED", tried)
        got = defaultdict(list)
        for r in profiles.related_works_of(df, asked, k).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.score, r.reasons))
        assert dict(got) == {q: [(r.id, r.score, r.reasons) for r in profiles.related_works(df, q, k).collect()] for q in ids[:4]}
    assert profiles.related_works_of(df.where("false"), asked).count() == 0
    df.unpersist()


def test_related_works_of_a_set_make_no_product(spark):
    from __spark_entry__ import queries

    assert "CartesianProduct" not in (plan := _plan(queries()["e11_related_works_set"](spark, SMALL))) and "NestedLoop" not in plan


def test_related_works_of_a_set_gather_no_pairs(spark, monkeypatch):
    """Pairs are scored where they meet, once each, and a task keeps the first of each entry: none are aggregated or sorted before."""
    import re

    from __spark_entry__ import queries
    from tomeatlas.operators import profiles

    plan = _plan(queries()["e11_related_works_set"](spark, SMALL))
    assert "MapInArrow" in plan and not re.search(r"keys=\[qid#\d+L?, pid#\d+L?\]", plan)
    monkeypatch.setattr(profiles, "PAIRS_HELD", 50)
    pairs = spark.range(4000).selectExpr("id % 7 as qid", "id as pid", "case when id > 70 then 4000 - id end as ord", "cast(id % 3 as int) as score").repartition(2)
    got = [tuple(r) for r in profiles._first_pairs(pairs, 3).orderBy("qid", "rank").select("qid", "score", "ord").collect()]
    rows = sorted(((i % 7, -(i % 3), 4000 - i if i > 70 else -1) for i in range(4000)))
    want = [r for q in range(7) for r in [r for r in rows if r[0] == q][:3]]
    assert [(q, -score, -1 if o is None else o) for q, score, o in got] == want
