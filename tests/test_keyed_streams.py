"""State by key: bare sessions, timers, starts from what is known."""

from __future__ import annotations

import shutil
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tests.test_flows import SMALL, event_frame, slow_limit
from tomeatlas.streaming import intake, keyed, limiter


def test_stream_queries_run_in_a_bare_session(spark):
    """The given session has no state store for keyed state, and is left as it is."""
    from __spark_entry__ import queries

    bare = spark.newSession()
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    bare.conf.set(keyed.PROVIDER, other)
    one, two = (queries()[n](bare, SMALL) for n in ("n4_rate_limit_stream", "n4_rate_limit"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert queries()["n3_append_stream"](bare, SMALL).count() > 0
    assert bare.conf.get(keyed.PROVIDER) == other


def test_timers_drop_idle_keys(spark, tmp_path):
    events = [(i, k, t) for i, (k, t) in enumerate((k, t) for t in range(0, 90, 3) for k in range(8))]
    later = [(1000, 99, 5000), (1001, 3, 5001), (1002, 3, 5002)]
    last = [(2000, 99, 9000)]
    source, session = str(tmp_path / "in"), keyed.state_session(spark)
    left = []
    for part in (events, later, last):
        event_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema("event_id bigint, user_id bigint, ts timestamp").parquet(source)
        out = limiter.rate_limit_stream(stream, "user_id", "ts", 3, late_s=10)
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        done = writer.outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
        state = session.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "accepted").load()
        left.append({r["key"][0] for r in state.select("key").collect()})
    assert left[0] >= set(range(8)) and not left[2] & set(range(8))
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == slow_limit(events + later + last, 3, 60)


def test_state_starts_from_the_corpus_and_reads_it_once(spark, tmp_path):
    """After the first micro-batch the corpus may even be gone: its keys are still known."""
    session = keyed.state_session(spark)

    def frame(*titles):
        data = [(i, t, "A", [t, None], 2.5, datetime(2024, 1, 1, 0, 0, i, 123456, tzinfo=timezone.utc)) for i, t in enumerate(titles)]
        return session.createDataFrame(data, "ord bigint, book_title string, author string, tags array<string>, x double, seen_at timestamp")

    corpus, source = str(tmp_path / "corpus"), str(tmp_path / "in")
    intake.seed_corpus(frame("Known", "Old"), corpus)
    for n, titles in enumerate((("known ", "New", "new"), ("NEW", "Newer", "OLD", "known"), ("newer ", "Newest"))):
        frame(*titles).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema(frame("x").schema).parquet(source)
        intake.append_stream(stream, corpus, str(tmp_path / "cp")).awaitTermination()
        if n == 0:
            shutil.rmtree(f"{corpus}/batch=-1")
    rows = spark.read.parquet(corpus).orderBy("batch", "ord").collect()
    assert [(r.batch, r.book_title) for r in rows] == [(0, "New"), (1, "Newer"), (2, "Newest")]
    assert (rows[0].tags, rows[0].x, rows[0].seen_at.microsecond) == (["New", None], 2.5, 123456)


def test_first_of_a_key_with_null_keys_and_orders(spark, tmp_path):
    session = keyed.state_session(spark)
    df = session.createDataFrame([(3, None, "c"), (2, None, "b"), (None, "k", "a"), (1, "k", "d")], "ord int, key string, v string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = session.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    first = keyed.first_of_key(stream, ["key"], session.createDataFrame([], "key string"))
    writer = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("v")).collect()) == ["a", "b"]


def test_limiter_reads_and_writes_a_key_once_in_a_batch():
    """Calls of the state store by one key: one read, one write and its timer's move, whatever the store has of other timers."""
    import pandas as pd

    calls = []

    class Store:
        held = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    own = limiter._Limiter("user_id", "ts", "event_id", 2, 60, True)
    own.init(Store())
    out = []
    for seconds in ([10, 5, 5], [80, 66, 64], [81]):
        rows = pd.DataFrame({"user_id": 1, "ts": pd.to_datetime(seconds, unit="s"), "event_id": range(len(seconds))})
        out += [pd.concat(own.handleInputRows((1,), iter([rows[:1], rows[1:]]), None))]
    assert [list(zip(o["event_id"], o["accepted"])) for o in out] == [[(1, True), (2, True), (0, False)], [(2, False), (1, True), (0, True)], [(0, False)]]
    # the last batch accepts none, so its timer stays
    assert calls == ["get", "update", ("register", 65001), "get", "update", ("delete", 65001), ("register", 140001), "get", "update"]
