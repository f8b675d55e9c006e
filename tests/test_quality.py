import json
import os
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tomeatlas.functions import geo, quality
from tomeatlas.functions.text import url_key
from tomeatlas.operators.spatial import nearest_seed_city
from tomeatlas.plans.cleanup import with_provenance
from tomeatlas.plans.release import ReleaseRefused, cut_release, gate_report
from tomeatlas.schema import CAMEL, PLACE, to_snake
from tomeatlas.sources.readers import read_release
from tomeatlas.sources.writers import detail_documents


def rows(spark, *records):
    blank = {f.name: None for f in PLACE.fields}
    data = [{**blank, "ord": i, "id": f"r{i}", **r} for i, r in enumerate(records)]
    return spark.createDataFrame([Row(**d) for d in data], PLACE)


@pytest.mark.parametrize(
    "place, grain",
    [("Seattle", "city"), ("Roman Empire", "region"), ("", "region"), ("Texas", "region"), ("Paris and London", "region"), ("Peru", "region"), ("Oslo", "city"), ("Empires", "city")],
)
def test_granularity(value, place, grain):
    assert value(quality.place_granularity("p"), p=place) == grain


@pytest.mark.parametrize(
    "n, source, quotes, want",
    [
        (0, "x", "", "none"), (59, "x", "", "short_stub"), (60, "x", "", "other"), (319, "wikidata", "", "wikidata_stub"),
        (320, "wikidata", "", "other"), (100, "openlibrary", "", "ol_description"), (100, "wikipedia", "", "wikipedia_summary"),
        (398, "x", '""', "literary_excerpt"), (398, "x", "", "other"), (399, "x", "'", "literary_excerpt"), (399, "x", '"', "other"),
    ],
)
def test_passage_type(value, n, source, quotes, want):
    assert value(quality.passage_type("p", "s"), p=" " + "z" * n + quotes + " ", s=source) == want


def test_passage_with_an_article_is_no_excerpt(value):
    assert value(quality.passage_type("p", "s"), p="The " + "z" * 500 + "'", s="x") == "other"


def test_geo_quality(spark):
    df = rows(
        spark,
        dict(place_name="Oslo", lon=10.7522, lat=59.9139, coordinate_confidence=0.85, coordinate_precision_km=15.0),
        dict(place_name="Seattle", lon=10.75, lat=59.91, coordinate_confidence=0.85),
        dict(place_name="unknown coast", lon=10.0, lat=10.5, coordinate_confidence=0.36, coordinate_precision_km=100.0),
        dict(place_name="A and B", coordinate_confidence=None, place_granularity="region"),
        dict(place_name="Oslo", lon=0.00015, lat=2e-5, coordinate_confidence=1.0),
    )
    got = {r["ord"]: (round(r["geo_quality"], 6), r["geo_risk_flags"]) for r in quality.with_geo_quality(df).collect()}
    assert got[0] == (1.0, [])
    assert got[1] == (0.7, ["broad_or_region_place"])  # "sea" is part of the name
    assert got[2] == (0.0, ["broad_or_region_place", "uncertain_place_label", "coarse_coordinate_precision", "low_spatial_precision"])
    assert got[3] == (0.0, ["composite_place_label", "broad_or_region_place", "coarse_coordinate_precision", "low_coordinate_confidence"])
    assert got[4] == (0.85, ["coarse_coordinate_precision"])


def test_tiers(spark):
    full = dict(book_title="t", author="a", publish_year=1990, place_name="Oslo", passage="p" * 150, themes=["a", "b", "c"], emotions=["x", "y"], polarity=0.5)
    df = rows(
        spark, full, {**full, "passage": "p" * 149}, {**full, "polarity": 0.0}, {**full, "publish_year": 0, "themes": []},
        {**full, "passage_type": "wikidata_stub"}, {**full, "themes": None, "place_granularity": "region"},
    )
    strict = [r["t"] for r in df.orderBy("ord").select(quality.tier_strict().alias("t")).collect()]
    assert strict == ["gold", "silver", "silver", "stub", "silver", "stub"]
    lenient = [r["t"] for r in df.orderBy("ord").select(quality.tier_lenient().alias("t")).collect()]
    assert lenient == ["gold", "gold", "gold", "silver", "gold", "silver"]


def test_gate_is_monotone(spark):
    names = ["Oslo", "Seattle", "unknown village", "A and B", "Texas"]
    df = rows(spark, *[dict(book_title="t", author="a", publish_year=1900, place_name=n, lon=1.234, lat=2.345) for n in names])
    df = quality.with_geolocation_fields(df)
    passed = [quality.quality_gate(df, t, g, reject=True).count() for t, g in ((0.0, 0.0), (0.5, 0.5), (0.8, 0.9))]
    assert passed == sorted(passed, reverse=True)
    loose = quality.quality_gate(df, 0.0, 0.0, allow_composite=True, reject=True).count()
    assert loose == len(names) and passed[0] == len(names) - 1


def test_coord_status(value):
    cases = [(None, 1.0, "missing"), (181.0, 91.0, "out_of_range"), (0.0, 0.0, "null_island"), (179.9, -89.0, "ok"), (0.5, 0.0, "ok")]
    for lon, lat, want in cases:
        assert value(geo.coord_status("x", "y"), x=(lon, "double"), y=(lat, "double")) == want


def test_release_refused_and_read_back(spark, tmp_path):
    good = dict(book_title="t", author="a", publish_year=1900, place_name="Oslo", lon=1.234, lat=2.345)
    gated = quality.quality_gate(quality.with_geolocation_fields(rows(spark, good, {**good, "place_name": "A and B"})))
    root = str(tmp_path / "releases")
    with pytest.raises(ReleaseRefused):
        cut_release(gated, root, "v1", gate_report(gated), min_ratio=0.9)
    first = cut_release(gated, root, "v1", gate_report(gated), min_ratio=0.5).first()
    again = cut_release(gated.repartition(3).orderBy(F.desc("ord")), root, "v2").first()
    assert first["entries"] == again["entries"] == 2 and first["passing_ratio"] == 0.5
    assert first["checksum"] == again["checksum"]
    assert {r["release"] for r in read_release(spark, root).collect()} == {"v2"}
    assert read_release(spark, root, "v1").count() == 2


# folder of published rows, one JSON document per file
DETAILS = Path(os.environ.get("PUBLISHED_ROWS") or "/nonexistent")


@pytest.mark.skipif(not DETAILS.exists(), reason="PUBLISHED_ROWS is not set")
def test_published_rows(spark):
    """Derived fields of published rows come out the same when computed again."""
    raw = spark.read.schema(CAMEL).json(str(DETAILS))
    given = to_snake(raw, keep=())
    inputs = given.select("id", "book_title", "author", "publish_year", "place_name", "passage", "language", "genres", "region", "source", "lon", "lat", "polarity", "emotions", "themes")
    again = quality.quality_gate(with_provenance(inputs)).withColumn("_n", nearest_seed_city("lon", "lat"))
    fields = ("place_granularity", "passage_source", "passage_type", "enrichment_method", "coordinate_source", "quality_tier", "quality_score", "quality_passed", "geo_risk_flags")
    both = given.select("id", *[F.col(c).alias(f"w_{c}") for c in fields], "nearest_known_city", "nearest_known_city_distance_km", F.col("geo_quality").alias("w_geo")).join(again, "id")
    wrong = [F.col(f"w_{c}") != F.col(c) for c in fields]
    wrong += [
        F.col("nearest_known_city") != F.col("_n.city"), F.abs(F.col("w_geo") - F.col("geo_quality")) > 1e-9,
        F.abs(F.col("nearest_known_city_distance_km") - F.round("_n.distance_km", 2)) > 0.011,
    ]
    counts = both.agg(F.count("*").alias("n"), *[F.count_if(w).alias(f"bad{i}") for i, w in enumerate(wrong)]).first().asDict()
    assert counts.pop("n") == given.count() > 400
    assert set(counts.values()) == {0}, counts


def test_detail_document(spark):
    doc = detail_documents(rows(spark, dict(id="x?", place_name="Oslo", lon=1.0, lat=2.0, open_library_key="/works/OL1W"), dict(id=""))).collect()
    assert len(doc) == 1
    body = json.loads(doc[0]["document"])
    assert body["spatialCoverage"] == body["contentLocation"] == {"@type": "Place", "name": "Oslo", "geo": {"@type": "GeoCoordinates", "longitude": 1.0, "latitude": 2.0}}
    assert body["sameAs"] == ["https://openlibrary.org/works/OL1W"] and body["@type"] == "Book"
    assert doc[0]["key"] == spark.range(1).select(url_key(F.lit("x?")).alias("k")).first()["k"]
