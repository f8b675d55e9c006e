"""What keeps memory and disk in bounds on large tables: plans, batches and blocks."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_flows import _plan
from tomeatlas.operators import extract, fuzzy, profiles, spatial, vectors
from tomeatlas.sources import readers


def test_rows_repeated_over_cells_are_shuffled(spark):
    at = F.col("id").cast("double")
    points = spark.range(100).select(F.col("id").alias("ord"), at.alias("lon"), (at / 2).alias("lat"))
    centres = spark.range(50).select(F.col("id").alias("centre_id"), at.alias("centre_lon"), at.alias("centre_lat"))
    assert "BroadcastHashJoin" not in _plan(spatial.within_radius(points, centres, 700_000))
    # the centres themselves may be broadcast, their cells may not
    assert "BroadcastHashJoin [level" not in (plan := _plan(spatial.nearby(points, centres, 700_000, 5))) and "SortMergeJoin [level" in plan


def test_nearby_of_a_centre_without_id_or_with_two_places(spark):
    points = spark.createDataFrame([(i, i / 100, 0.0) for i in range(30)], "ord bigint, lon double, lat double")
    centres = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (None, 0.0, 0.0)], "centre_id bigint, centre_lon double, centre_lat double")
    got = sorted((r.centre_id or 0, r.rank, r.ord, r.fallback) for r in spatial.nearby(points, centres, 1_500, 4, min_hits=4).collect())
    assert got == [(0, i + 1, i, True) for i in range(4)] + [(1, i + 1, i // 2, False) for i in range(4)]


def test_pairs_beyond_the_nearest_are_dropped_where_they_meet(spark):
    """The farthest corner of a centre's block bounds its k nearest, at poles and the antimeridian too; the bound comes before any sort of pairs."""
    import math
    import re

    rng = np.random.default_rng(6)
    at = [(-180.0, 0.0), (180.0, 10.0), (0.0, 90.0), (12.0, -90.0), (179.99, 89.9), (-0.001, 0.001)] + [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 40), rng.uniform(-90, 90, 40))]
    corners = []
    for i, (lon, lat) in enumerate(at):
        for fit in range(1, 11):
            w = 360 / 2**fit
            x, y = min(math.floor((lon + 180) / w), 2**fit - 1), math.floor((lat + 90) / w)
            for u, v in rng.uniform(0, 1, (20, 2)).round().tolist():
                corners.append((lon, lat, fit, (x - 1 + 3 * u) * w - 180, float(np.clip((y - 1 + 3 * v) * w - 90, -90, 90))))
    df = spark.createDataFrame(corners, "lon double, lat double, fit int, x double, y double")
    far = spatial.haversine("lon", "lat", "x", "y")
    assert df.where(far > spatial._reach(F.col("lon"), F.col("lat"), F.col("fit"))).count() == 0

    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 400), rng.uniform(-90, 90, 400)))] + [(400 + i, 180.0 - i % 2 * 360, 0.0) for i in range(6)]
    centres = [(i, lon, lat) for i, (lon, lat) in enumerate(at)] + [(500, 10.0, 10.0), (500, 11.0, 80.0), (501, None, 1.0)]
    near = spatial.knn(spark.createDataFrame(points, "ord bigint, lon double, lat double"), spark.createDataFrame(centres, "centre_id bigint, centre_lon double, centre_lat double"), 3)
    plan = _plan(near)
    first = plan.splitlines().index(next(x for x in reversed(plan.splitlines()) if re.search(r"Window.*distance_m", x)))
    assert "_reach" in "".join(plan.splitlines()[first:])
    got = {}
    for r in near.collect():
        got.setdefault(r.centre_id, []).append((r["rank"], r.ord, r.distance_m))

    def metres(a, b):
        s1, s2 = math.sin(math.radians(b[1] - a[1]) / 2), math.sin(math.radians(b[0] - a[0]) / 2)
        h = s1 * s1 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * s2 * s2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))

    for i in {i for i, *_ in centres[:-1]}:
        want = sorted(metres(c[1:], p[1:]) for c in centres if c[0] == i for p in points)[:3]
        assert np.allclose([m for *_, m in sorted(got[i])], want, atol=0.01)
    assert [o for _, o, _ in sorted(got[501])] == [0, 1, 2]  # a centre without a place has the first rows, as before


def test_bundles_of_full_texts(spark, tmp_path):
    texts = {1: "a\nb", 2: "", 3: "\\n\n\\\\\n\\", 4: "x\r\ny\t\\t\\\t", 5: "\n", 6: "\n\n\\r"}
    rows = [(str(i), t) for i, t in texts.items()] + [("7", None), (None, "no id"), ("1", "again")]
    readers.write_fulltext(spark.createDataFrame(rows, "book_id string, text string").repartition(2), str(tmp_path / "b"))
    got = sorted((r.book_id or "", r.text) for r in readers.read_fulltext(spark, str(tmp_path / "b"), bundled=True).collect())
    assert got == sorted((i or "", t or "") for i, t in rows)
    assert len(list((tmp_path / "b").glob("part-*"))) == 2


def test_pairs_of_places_are_not_shuffled(spark):
    df = spark.createDataFrame([("x" if i % 2 else "y", f"p{i}", float(i), 1.0, i) for i in range(60)], "author string, place_name string, lon double, lat double, ord bigint")
    got = profiles.author_connections(df, ["x", "y"], bucket=4)
    joins = [line for line in _plan(got).splitlines() if "Join" in line]
    assert "x#" in joins[0] and "y#" in joins[0]  # the last join makes the pairs
    assert got.count() == 2 * 30 * 29 // 2 and {r.book_count for r in got.collect()} == {30}


def test_pairs_of_strings_are_verified_where_they_meet(spark):
    names = spark.createDataFrame([("abcd",), ("abce",), ("zzz",)], "value string")
    assert "HashAggregate" not in _plan(pairs := fuzzy.similar_strings(names, names, 0.3))
    assert sorted((r.query, r.value) for r in pairs.collect()) == [("abcd", "abcd"), ("abcd", "abce"), ("abce", "abcd"), ("abce", "abce"), ("zzz", "zzz")]


def test_scores_of_a_block_are_held_by_tiles():
    rng = np.random.default_rng(1)
    frame = lambda n: pd.DataFrame({"ord": np.arange(n), "embedding": list(rng.integers(-2, 3, size=(n, 3)).astype(float))})
    a, b = frame(2000), frame(12_000)
    tracemalloc.start()
    got = pd.concat(vectors._neighbours(a, b, 5, 0.4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # all scores are 192 MB, with copies several times that
    unit = vectors._unit(b["embedding"])
    for i in (0, 700, 1999):
        s = vectors._unit(a["embedding"].iloc[i : i + 1])[0] @ unit.T
        s[i] = -1
        want = sorted((-round(x, 9), j) for j, x in enumerate(s) if x > 0.4)[:5]
        mine = got[got["ord"] == i]
        assert sorted(-round(x, 9) for x in mine["score"]) == [x for x, _ in want]


def test_texts_are_taken_one_by_one(spark):
    text = "Ann went to Delhi and then back to Delhi again, far away. " * 3000
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id bigint, text string, lang string")
    named = spark.createDataFrame([(1, "Delhi", 0.5, 7), (1, "Ann", None, 8), (2, "Delhi", 0.5, 9)], "doc_id bigint, mention string, lon double, n int")
    windows = extract.context_windows(docs, named, most=6_000)
    assert "MapInArrow" in _plan(windows)  # rows of a whole batch were gathered in pandas before
    rows = windows.collect()
    assert [sum(r.mention == m for r in rows) for m in ("Delhi", "Ann")] == [6_000, 3_000]
    assert {(r.doc_id, r.lang, r.mention, r.lon, r.n) for r in rows} == {(1, "x", "Delhi", 0.5, 7), (1, "x", "Ann", None, 8)}
    assert sorted(r.passage_no for r in rows if r.mention == "Ann") == list(range(1, 3_001))
    assert "MapInArrow" in _plan(chunks := extract.chunk_text(docs))
    parts = chunks.orderBy("chunk").collect()
    assert all(r.doc_id == 1 and r.text == text[r.start_char : r.end_char] for r in parts) and parts[-1].end_char == len(text)


def test_a_micro_batch_of_many_rows_has_several_files(spark, tmp_path, monkeypatch):
    from workload import flows

    monkeypatch.setattr(flows, "scratch_path", lambda spark, name: str(tmp_path / name))
    flows._as_stream(spark, spark.range(50_000), "rows", 2)
    assert len(list((tmp_path / "rows").glob("part-*"))) == 6
