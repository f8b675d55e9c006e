import json
import random
import re
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_quality import rows
from tomeatlas.operators.dedup import with_row_key
from tomeatlas.plans.scratch import materialise, scratch_path
from tomeatlas.streaming import intake, limiter
from workload.text import scripted_model

SMALL = "/root/testdata/sf0.001"


def slow_limit(events, limit, window):
    """Acceptance decided event by event."""
    seen, out = {}, {}
    for e, k, t in sorted(events, key=lambda x: (x[2], x[0])):
        q = seen.setdefault(k, deque())
        while q and t - q[0] > window:
            q.popleft()
        out[e] = len(q) < limit
        if out[e]:
            q.append(t)
    return out


def event_frame(spark, events):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(e, k, start + timedelta(seconds=t)) for e, k, t in events]
    return spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp")


@pytest.mark.parametrize("limit, window", [(1, 60), (2, 60), (5, 30), (40, 60)])
def test_limiter_equals_slow_one(spark, limit, window):
    rng = random.Random(limit)
    times = {1: [0, 1, 2, 59, 60, 61, 120, 121, 181, 181, 181]}
    times[2] = [rng.randrange(0, 4000) for _ in range(700)]  # a third of all events on one key
    for k in range(3, 40):
        times[k] = [rng.randrange(0, 20_000) for _ in range(rng.randrange(1, 60))]
    flat = [(k, t) for k, ts in times.items() for t in ts]
    rng.shuffle(flat)
    events = [(i, k, t) for i, (k, t) in enumerate(flat)]
    want = slow_limit(events, limit, window)
    for parts in (1, 7):
        df = event_frame(spark, events).repartition(parts)
        got = {r["event_id"]: r["accepted"] for r in limiter.rate_limit(df, "user_id", "ts", limit, window).collect()}
        assert got == want


def test_busy_keys_fall_apart(spark):
    """A key with calm moments is decided in several independent stretches."""
    events = [(i, 1, t) for i, t in enumerate([0, 1, 2, 3, 400, 401, 900, 901, 902, 1000])]
    buckets = event_frame(spark, events).select(F.col("user_id").alias("key"), F.floor(F.unix_seconds("ts") / 60).alias("bucket"))
    segments = limiter._segments(buckets.groupBy("key", "bucket").agg(F.count("*").alias("n")), 2)
    assert segments.select("seg").distinct().count() > 2


def test_limiter_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    events = [(i, rng.randrange(6), t) for i, t in enumerate(sorted(rng.randrange(0, 3000) for _ in range(600)))]
    source = str(tmp_path / "in")
    for part in range(3):  # three arrivals in time order
        event_frame(spark, events[part * 200 : part * 200 + 200]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").parquet(source)
        out = limiter.rate_limit_stream(stream, "user_id", "ts", 3)
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == slow_limit(events, 3, 60)


def test_contribution_stream_goes_on_after_a_stop(spark, tmp_path):
    good = ("t", "a", 1900, "p", [1.0, 2.0], "text", ["x"], None)
    bad = [("", *good[1:]), (*good[:4], [1.0], *good[5:]), (*good[:4], [181.0, 0.0], *good[5:]), (*good[:6], None, None), (*good[:4], None, *good[5:])]
    source = str(tmp_path / "in")
    for batch in ([good, bad[0]], [good, *bad[1:]]):
        spark.createDataFrame(batch, intake.CONTRIBUTION).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(intake.CONTRIBUTION).parquet(source)
        intake.contribution_stream(stream, str(tmp_path / "q"), str(tmp_path / "f"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    faults = sorted(r["fault"] for r in spark.read.parquet(str(tmp_path / "f")).collect())
    assert faults == sorted(
        ["missing book_title", "coordinates must be [longitude, latitude]", "coordinates out of range", "missing themes", "coordinates must be [longitude, latitude]"]
    )


def test_enrichment_stream_ignores_replays(spark, tmp_path):
    df = with_row_key(rows(spark, *[dict(passage="x" * n) for n in (5, 200, 300)])).select("row_key", "ord", "id", "passage")
    source = str(tmp_path / "in")
    for part in (df, df.filter("ord > 0")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        intake.enrichment_stream(stream, scripted_model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    results = spark.read.parquet(str(tmp_path / "out"))
    assert results.count() == 3
    first = {r["row_key"]: (r["status"], r["batch"]) for r in intake.read_stream_results(results).collect()}
    assert first == {"0:r0": ("failed", 0), "1:r1": ("ok", 0), "2:r2": ("ok", 0)}


def test_append_stream_keeps_the_first(spark, tmp_path):
    def frame(*titles):
        data = [(i, f"id{i}", t, "A", datetime(2024, 1, 1, 0, i, tzinfo=timezone.utc)) for i, t in enumerate(titles)]
        return spark.createDataFrame(data, "ord bigint, id string, book_title string, author string, seen_at timestamp")

    corpus, source = str(tmp_path / "corpus"), str(tmp_path / "in")
    intake.seed_corpus(frame("Known"), corpus)
    for titles in (("known ", "New", "new"), ("NEW", "Newer")):
        df = frame(*titles)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        intake.append_stream(stream, corpus, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["key0"] for r in spark.read.parquet(corpus).collect()) == ["known", "new", "newer"]


def test_scratch_needs_the_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert sorted(r["id"] for r in materialise(spark.range(3), "t").collect()) == [0, 1, 2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PLANNED = [
    "f4_filter_years", "g1_city_profile", "g7_quality_metrics", "l1_dedup_first", "l2_dedup_best", "l5_minmax", "e4_geocode", "e5_nearest_city",
    "e9_within_radius", "e10_nearby", "e11_related_works", "e12_author_connections", "m1_nearest_vectors", "k1_extract_mentions", "n4_rate_limit", "p1_cleanup_data",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans(spark, name):
    """No product of two tables, and no ranking of a whole table in one task."""
    from __spark_entry__ import queries

    plan = _plan(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert not re.search(r"\bWindow\b", "\n".join(lines[max(0, i - 3) : i]))


def test_ranks_are_cut_before_the_shuffle(spark):
    from __spark_entry__ import queries

    assert "WindowGroupLimit" in _plan(queries()["l1_dedup_first"](spark, SMALL))


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    from tomeatlas.operators.search import filter_places, filter_years
    from tomeatlas.operators.spatial import near_point
    from tomeatlas.sources.readers import read_places
    from tomeatlas.sources.writers import write_places

    path = str(tmp_path / "p")
    stats = write_places(rows(spark, dict(passage="x", themes=["a"]), dict(passage=" ")), path)
    assert stats == {"total": 2, "with_passage": 1, "with_themes": 1}
    df = read_places(spark, path)
    years = _plan(filter_years(df, 1900, 1950).select("id"))
    assert "ReadSchema: struct<id:string,publish_year:int>" in years
    box = _plan(near_point(df, 10.0, 50.0, 1000.0, 5, min_hits=0).select("id"))
    assert "GreaterThanOrEqual(lat" in box
    assert "ReadSchema: struct<id:string,author:string>" in _plan(filter_places(df, author="x").select("id"))


def test_every_query_has_a_builder():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_limiter_takes_a_null_key_as_a_key(spark):
    events = spark.createDataFrame(
        [(i, None if i % 2 else 1, datetime(2024, 1, 1, 0, 0, i, tzinfo=timezone.utc)) for i in range(10)], "event_id bigint, user_id bigint, ts timestamp"
    )
    got = limiter.rate_limit(events, "user_id", "ts", 3).collect()
    assert len(got) == 10
    assert sorted(r["event_id"] for r in got if r["accepted"]) == [0, 1, 2, 3, 4, 5]


def test_limiter_stream_over_many_arrow_batches(spark, tmp_path):
    """One key whose rows of a micro-batch come in many Arrow batches, unordered."""
    rng = random.Random(11)
    events = [(i, 7, t) for i, t in enumerate(rng.randrange(0, 600) for _ in range(200))]
    source = str(tmp_path / "in")
    event_frame(spark, events).repartition(4).write.parquet(source)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").parquet(source)
        out = limiter.rate_limit_stream(stream, "user_id", "ts", 3)
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == slow_limit(events, 3, 60)


def test_append_stream_keeps_late_rows(spark, tmp_path):
    def frame(days, first):
        data = [(i, f"id{i}", f"Title {i}", "A", datetime(2024, 1 + d // 28, 1 + d % 28, tzinfo=timezone.utc)) for i, d in enumerate(days, first)]
        return spark.createDataFrame(data, "ord bigint, id string, book_title string, author string, seen_at timestamp")

    corpus, source = str(tmp_path / "corpus"), str(tmp_path / "in")
    intake.seed_corpus(frame([0], 0), corpus)
    for first, days in ((1, [60, 61]), (3, [2, 62]), (5, [1])):
        frame(days, first).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame([0], 0).schema).parquet(source)
        intake.append_stream(stream, corpus, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["key0"] for r in spark.read.parquet(corpus).collect()) == [f"title {i}" for i in range(6)]


def test_one_bad_row_fails_alone(spark):
    from tomeatlas.operators.extract import infer

    def picky(batch):
        if (batch["id"] == 777).any():
            raise ValueError("no")
        return batch["id"].astype(str) if len(batch) % 2 else batch["id"].astype(str)[:-1]

    got = infer(spark.range(2000), picky, "relaxed").collect()
    assert len(got) == 2000
    assert [r["id"] for r in got if r["result"] is None] == [777]


def test_queries_run_from_another_folder(tmp_path):
    """Only the entry file's folder is on the driver's path; executors get the library as a file."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate()\n"
        f"print('ROWS', e.queries()['k3_chunk_text'](spark, {SMALL!r}).count())\n"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in ran.stdout, ran.stderr[-2000:]


def test_very_long_texts_stay_whole(spark):
    from tomeatlas.sources.parsers import parse_work_json
    from tomeatlas.sources.readers import one_line, unfolded

    text = "long text\n" * 150_000
    work = spark.createDataFrame([(json.dumps({"description": text}),)], "work string")
    assert parse_work_json(work).first()["description"] == text
    odd = spark.createDataFrame([("a\\n\n\r\\\\ b",)], "t string")
    folded = odd.select(one_line("t").alias("t"))
    assert "\n" not in folded.first()["t"] and folded.select(unfolded("t").alias("t")).first()["t"] == odd.first()["t"]
