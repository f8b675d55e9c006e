"""Bucket merges, release digests, SQL functions and the nearest city of a table."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_flows import _plan


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    from tomeatlas.sources.buckets import create_buckets, merge_buckets, read_buckets

    root = f"{tmp_path}/table"
    rows = spark.createDataFrame([(i, f"e{i}" if i else None, "old") for i in range(200)], "ord long, id string, state string")
    with pytest.raises(ValueError, match="no bucket table"):
        read_buckets(spark, root)
    create_buckets(rows, root, 16)
    before = read_buckets(spark, root)
    files = set(before.inputFiles())
    updates = spark.createDataFrame([(300, "e7", "stale"), (301, "e7", "new"), (302, "more", "new")], "ord long, id string, state string")
    touched = merge_buckets(updates, root)
    after = read_buckets(spark, root)
    kept = {f for f in files if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and kept < set(after.inputFiles()) and not (files - kept) & set(after.inputFiles())
    want = {(None if i == 0 else f"e{i}", "new" if i == 7 else "old") for i in range(200)} | {("more", "new")}
    assert {(r.id, r.state) for r in after.collect()} == want and after.count() == 201
    assert before.count() == 200  # the earlier version is still whole

    broken = updates.withColumn("state", F.when(F.col("ord") == 302, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        merge_buckets(broken, root)
    assert {(r.id, r.state) for r in read_buckets(spark, root).collect()} == want
    merge_buckets(updates.limit(1).withColumn("further", F.lit(1)), root)
    assert {(r.id, r.further) for r in read_buckets(spark, root).where("id in ('e7', 'e8')").collect()} == {("e7", 1), ("e8", None)}
    assert merge_buckets(updates.where("false"), root) == set()
    create_buckets(rows.where("false"), f"{root}-empty", 4)
    assert read_buckets(spark, f"{root}-empty").count() == 0 and merge_buckets(updates, f"{root}-empty") and read_buckets(spark, f"{root}-empty").count() == 2


def test_digest_tree_names_the_changed_leaf(spark):
    from tomeatlas.plans.digest_tree import changed_leaves, changed_rows, digest_tree, tree_depth

    rows = [(i, f"text {i}", ["a", None] if i % 2 else None) for i in range(300)] + [(7, "again", []), (None, "x", []), (None, "x", [])] + [(1, f"hot {i}", []) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    tree = digest_tree(df, "id", 2)
    nodes = {(r.level, r.prefix): (r.entries, r.digest) for r in tree.collect()}
    assert nodes[0, ""][0] == len(rows) == sum(n for (level, _), (n, _) in nodes.items() if level == 2)
    again = digest_tree(df.repartition(5).orderBy(F.desc("text")), "id", 2)
    assert {(r.level, r.prefix): (r.entries, r.digest) for r in again.collect()} == nodes
    edited = df.withColumn("text", F.when(F.col("text") == "hot 50", "hot fifty").otherwise(F.col("text")))
    other = digest_tree(edited, "id", 2)
    leaves = changed_leaves(tree, other)
    assert leaves.count() == 1
    differ = {k for k, v in {(r.level, r.prefix): (r.entries, r.digest) for r in other.collect()}.items() if nodes[k] != v}
    assert sorted(level for level, _ in differ) == [0, 1, 2]
    assert [tuple(r) for r in changed_rows(df, edited, "id", leaves, 2).collect()] == [(1, "changed", 101, 101)]
    fewer = df.where("id is not null and id <> 5").unionByName(spark.createDataFrame([(900, "x", [])], df.schema))
    found = changed_rows(df, fewer, "id", changed_leaves(tree, digest_tree(fewer, "id", 2)), 2)
    assert {tuple(r) for r in found.collect()} == {(5, "removed", 1, 0), (None, "removed", 2, 0), (900, "added", 0, 1)}
    assert digest_tree(df.where("false"), "id", 2).count() == 0
    assert [tree_depth(n, 10) for n in (0, 10, 11, 160, 161)] == [0, 0, 1, 1, 2]


def test_sql_functions_equal_the_column_rules_without_python(spark):
    from tomeatlas.functions.geo import haversine
    from tomeatlas.functions.sql import register_functions
    from tomeatlas.functions.text import norm_text, slug
    from tomeatlas.functions.trigram import trigrams

    assert "trigram_similarity" in register_functions(spark) and register_functions(spark)
    rows = [("  Été à  Paris ", 2.35, 48.85), ("", 0.0, 0.0), (None, None, 1.0), ("!!", 180.0, -90.0), ("New\t\nDelhi--x", -179.9, 12.5), ("naïve \\ 'q'", 77.2, 28.6)]
    df = spark.createDataFrame(rows, "s string, lon double, lat double")
    got = spark.sql("select norm_text(s) a, slug(s) b, haversine_m(lon, lat, 72.8, 19.0) c, trigrams(s) d, trigram_similarity(s, 'new delhi') e from {df}", df=df)
    want = df.select(norm_text("s"), slug("s"), haversine("lon", "lat", F.lit(72.8), F.lit(19.0)), trigrams("s"))
    assert [(r.a, r.b, r.c and round(r.c, 6), r.d) for r in got.collect()] == [(*tuple(r)[:2], r[2] and round(r[2], 6), r[3]) for r in want.collect()]
    assert [round(r.e, 6) for r in got.collect()][1:4] == [0.0, 0.0, 0.0] and got.collect()[4].e > 0.7
    assert "Python" not in _plan(got) and "haversine_m" not in _plan(got)


def test_nearest_city_of_a_table(spark):
    from tomeatlas.operators.spatial import nearest_city

    rng = random.Random(6)
    at = lambda: (round(rng.uniform(-180, 180), 3), round(rng.uniform(-90, 90), 3))
    points = [(i, *at()) for i in range(150)] + [(200 + i, 10.0, 10.0) for i in range(50)] + [(300, None, 5.0), (301, 179.99, 0.0), (302, 0.0, 90.0)]
    cities = [(i, f"c{i}", *at()) for i in range(40)] + [(50, "twin", 10.0, 10.0), (49, "first", 10.0, 10.0), (60, "west", -179.99, 0.0), (70, "nowhere", None, None)]
    df = spark.createDataFrame(points, "id long, lon double, lat double").withColumn("name", F.lit("mine"))
    table = spark.createDataFrame(cities, "ord long, name string, lon double, lat double")

    def km(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0))), 6)

    got = {r.id: (r.near_name, r.near_km and round(r.near_km, 6), r.name) for r in nearest_city(df, table).collect()}
    for i, lon, lat in points:
        best = min((km(lon, lat, c[2], c[3]), c[0], c[1]) for c in cities if c[2] is not None) if lon is not None else (None, None, None)
        assert got[i] == (best[2], best[0], "mine")
    assert {r.near_name for r in nearest_city(df, table.where("false")).collect()} == {None}
