"""Exact dedup, n-gram Jaccard join, line dedup and decontamination against brute force."""

from __future__ import annotations

import random

import cases
from pyspark.sql import functions as F


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_duplicates(spark):
    from tomeatlas.llm.radix_dedup import exact_duplicates

    docs = cases.documents(spark)
    got = exact_duplicates(docs, carry=docs.columns)
    assert set(docs.columns) < set(got.columns)
    rows = {r.doc_id: (r.dup_keep_id, r.dup_size, r.dup_kept, r.dup_sha256) for r in got.collect()}
    assert rows == cases.exact_groups(pairs(docs))


def test_exact_duplicates_of_repeated_rows_and_no_rows(spark):
    from tomeatlas.llm.radix_dedup import exact_duplicates

    docs = cases.documents(spark, ["same", "same", "s ame", None, "other"], [7, 7, 9, None, None])
    rows = exact_duplicates(docs).collect()
    assert sorted(r.dup_size for r in rows) == [1, 1, 3, 3, 3]
    assert sum(r.dup_kept for r in rows) == 3
    assert {r.dup_keep_id for r in rows if r.dup_size == 3} == {9}
    assert exact_duplicates(cases.no_documents(spark)).count() == 0


def test_exact_duplicates_by_shuffle_with_short_slices_and_clashing_names(spark, monkeypatch):
    import pytest

    from tomeatlas.llm import radix_dedup, stored

    docs = cases.documents(spark).withColumns({c: F.lit("mine") for c in (*radix_dedup.RESULT, "rest", "members", "ended")})
    want = cases.exact_groups(pairs(docs))
    for rows, first, growth in ((0, 1, 3), (10**6, 2, 2), (0, 32, 8)):
        monkeypatch.setattr(stored, "BROADCAST_ROWS", rows)
        got = radix_dedup.exact_duplicates(docs, docs.columns, first, growth, nested=True).collect()
        assert {r.row.doc_id: (r.dup_keep_id, r.dup_size, r.dup_kept, r.dup_sha256) for r in got} == want
        assert {(r.row.dup_kept, r.row.members) for r in got} == {("mine", "mine")}
    with pytest.raises(ValueError, match="dup_kept"):
        radix_dedup.exact_duplicates(docs, docs.columns)


def test_lone_rows_are_spread(spark, monkeypatch):
    """Nine in ten rows are alone in their part: no partition of the result has many more rows than the others."""
    from tomeatlas.llm import radix_dedup, stored

    texts = [f"{i} text {i * i}" for i in range(1800)] + ["same text"] * 200
    docs = cases.documents(spark, texts).repartition(8)
    monkeypatch.setattr(stored, "BROADCAST_ROWS", 0)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = radix_dedup.exact_duplicates(docs)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.where("dup_size = 200").count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert max(sizes) <= 2.5 * 2000 / 4


def test_similar_documents(spark):
    from tomeatlas.llm.jaccard_join import similar_documents

    docs = cases.documents(spark)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs).collect()}
    assert rows == cases.components(pairs(docs))


def test_similar_documents_need_the_last_round(spark):
    """Chains of copies that no common centre links, documents without id, repeated rows."""
    from tomeatlas.llm.jaccard_join import similar_documents

    rng = random.Random(5)
    chain = [[f"c{i}" for i in range(60)]]
    for step in range(30):
        nxt = list(chain[-1])
        nxt[rng.randrange(60)] = f"new{step}"
        chain.append(nxt)
    rng.shuffle(chain)
    texts = [" ".join(c) for c in chain]
    docs = cases.documents(spark, [*texts, texts[0], texts[1], None], [*range(len(texts)), 3, None, None])
    known = [(i, t) for i, t in pairs(docs) if i is not None and (i != 3 or t == texts[3])]
    want = cases.components(known)
    assert len({c for _, c in want.values()}) < len(want)
    linked_twice = {want[3][1], want[0][1]}
    for rounds in (0, 3):
        got = similar_documents(docs, star_rounds=rounds).collect()
        assert len(got) == len(texts) + 3
        for r in got:
            if r.doc_id is None:
                assert (r.n_shingles, r.component_id) == (0, None)
            elif want[r.doc_id][1] not in linked_twice:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert similar_documents(cases.no_documents(spark)).count() == 0


def test_repeated_lines(spark):
    from tomeatlas.llm.line_dedup import without_repeated_lines

    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["alpha", "béta", "gamma", "delta"]) for _ in range(rng.randrange(1, 9)))
    pool = [line() for _ in range(25)]

    def typo(x):
        i = rng.randrange(len(x))
        return [x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :], x][rng.randrange(4)]

    texts = ["\n".join(typo(rng.choice(pool)) for _ in range(rng.randrange(0, 9))) for _ in range(40)]
    texts += [None, "", "\n\n", " \t\n\n", "x" * 50_000, "x" * 49_999 + "y", "aaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaa", "short\nshirt"]
    docs = cases.documents(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in without_repeated_lines(docs).collect()}
    assert got == cases.kept_lines(pairs(docs))
    assert got[100 + len(texts) - 1][1] == 2
    assert without_repeated_lines(cases.no_documents(spark)).count() == 0


def test_repeated_lines_of_every_length_within_one_and_two_edits(spark):
    """Lines of 1 to 60 characters over two letters, so that many meet, each changed up to three times."""
    import pytest

    from tomeatlas.llm.line_dedup import repeated_lines, without_repeated_lines

    rng = random.Random(8)

    def changed(x, times):
        for _ in range(times):
            i = rng.randrange(len(x) + 1)
            x = [x[:i] + x[i + 1 :], x[:i] + rng.choice("abc") + x[i:], x[:i] + rng.choice("abc") + x[i + 1 :]][rng.randrange(3)]
        return x

    lines = []
    for n in range(1, 61):
        x = "".join(rng.choice("ab") for _ in range(n)) if n % 3 else "ab"[n % 2] * n
        lines += [x] + [changed(x, rng.randrange(4)) for _ in range(4)]
    lines += ["page 12 of report", "page 13 of report", "minutes of the meeting held in spring of 2019", "minutes of the meeting held in spring of 2020"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + [None, "", "\n \n"]
    docs = cases.documents(spark, texts)
    kept = []
    for edits, least in ((1, (8, 40)), (2, (8, 40)), (2, (3, 6))):
        got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in without_repeated_lines(docs, edits, least).collect()}
        assert got == cases.kept_lines(pairs(docs), edits, least)
        kept.append(sum(n for _, n, _ in got.values()))
    assert kept[0] > kept[1] > kept[2]
    with pytest.raises(ValueError, match="edits"):
        repeated_lines(docs, 3)


def test_variants_of_lines_are_not_broadcast(spark, monkeypatch):
    """Spark takes them for as small as the lines; where the other side is large too, both are shuffled, and the rows are the same."""
    import re

    from tomeatlas.llm import line_dedup
    from tomeatlas.llm.stored import Stored

    long = "a line that stands in many of the documents, " * 6
    docs = cases.documents(spark, [long + "a\nshort", "b\n" + long + "b", "short\n" + long + "c"])
    stored = Stored(spark, "lines")
    bodies = stored.save(docs.selectExpr("doc_id as doc", "1L as row", "0 as line", "text as chars"), "bodies")
    for most in (line_dedup.FEW, -1):
        monkeypatch.setattr(line_dedup, "FEW", most)
        for made in (line_dedup._within_one, line_dedup._within_two):
            plan = made(stored, bodies)._jdf.queryExecution().executedPlan().toString()
            sent, depth = [], None
            for line in plan.splitlines():
                at = re.search(r"[A-Za-z]", line)
                depth = None if at and depth is not None and at.start() <= depth else depth
                sent += [line] if depth is not None and "MapInArrow" in line else []
                depth = at.start() if at and depth is None and "BroadcastExchange" in line else depth
            assert "MapInArrow" in plan and not sent
            assert most > 0 or "BroadcastHashJoin" not in plan
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == cases.kept_lines(pairs(docs)) and sum(n for _, n, _ in got.values()) == 3


def test_contamination(spark):
    from tomeatlas.llm.winnowing import contamination

    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(1, some(25)), (2, some(10)), (3, some(4)), (4, None), (5, "  ,,"), (6, "ÉTÉ x"), (11, some(40))]
    items += [(7, items[0][1].upper()), (None, some(12)), (8, items[1][1]), (3, items[2][1])]
    whole = [t for _, t in items if t]
    texts = [some(rng.randrange(1, 80)) for _ in range(30)] + [some(9) + " " + rng.choice(whole) + " " + some(9) for _ in range(30)]
    texts += [whole[0][: len(whole[0]) // 2], "été X", None, "", "- -", some(30_000), whole[0] + ". " + whole[0]]
    docs = cases.documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in cases.CLASHING})
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench).collect()}
    assert got == cases.contaminated(pairs(docs), [x for x in items if x[0] is not None])
    assert contamination(cases.no_documents(spark), bench).count() == 0
    assert {r.n_hit for r in contamination(docs, bench.where("false")).collect()} == {0}
    twice = cases.documents(spark, [whole[0], whole[0], "a"], [1, 1, None])
    assert sorted((r.doc_id or 0, r.n_hit) for r in contamination(twice, bench).collect()) == [(0, 0), (1, 25)]


def test_a_task_of_the_similarity_join_holds_few_shingles_at_once(spark):
    """What a task holds while it deals out shingles, and while shingles meet, stays near the size of what it was given."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tomeatlas.llm import jaccard_join, stored

    rng = random.Random(7)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(2000)]
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(texts)})
    hashes, classes = [np.arange(i, 10**6, 8, dtype=np.uint64) * np.uint64(77) for i in range(8)], [np.full(125_000, i, np.uint64) for i in range(8)]
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in jaccard_join._dealt_batches(iter([batch]), 5, 16)) > 16
        assert tracemalloc.get_traced_memory()[1] < 35 << 20
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert len(jaccard_join._shared(0, hashes, classes)[0]) == 0 and not hashes and not classes
        assert tracemalloc.get_traced_memory()[1] - before < 44 << 20
    finally:
        tracemalloc.stop()
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    was = [spark.conf.get(n) for n in names]
    with stored.arrow_rows(spark, 500, 2 << 20):
        assert [spark.conf.get(n) for n in names] == ["500", str(2 << 20)]
    assert [spark.conf.get(n) for n in names] == was
