"""The pipeline against the brute-force versions of its stages."""

from __future__ import annotations

import random

import cases


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def tables(spark, folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ti", "on", "re", "th", "en", "ou"]) for _ in range(rng.randrange(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randrange(15, 120))) for _ in range(120)]
    items = [" ".join(word() for _ in range(20)) for _ in range(5)]
    junk = [" ".join([word()] * 40) for _ in range(40)] + [" | ".join(word() + "%%%" for _ in range(30)) for _ in range(40)]
    leaks = [f"{prose[i]} {items[i % 5]} {prose[i + 1]}" for i in range(8)]
    near = [p.replace(p.split(" ")[3], "other", 1) for p in prose[20:30] for _ in range(2)]
    texts = [*prose, *junk, *leaks, *near, *prose[:5], prose[6].replace(" ", "\n"), None, ""]
    rng.shuffle(texts)
    docs = cases.documents(spark, texts, list(range(len(texts))))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(t not in junk), 0) for i, t in enumerate(texts) if t and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i for i, t in enumerate(texts) if t in junk}, {i for i, t in enumerate(texts) if t and t not in junk}


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as c

    folder = str(tmp_path)
    bad, good = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(c.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept.append(dict(pairs(docs)))
    assert good <= kept[0].keys() and not bad & kept[0].keys()
    assert kept[1].keys() == {i for i, g in cases.exact_groups(kept[0].items()).items() if g[2]}
    assert kept[2].keys() == {i for i, g in cases.components(list(kept[1].items())).items() if g[1] == i}
    items = pairs(spark.read.parquet(f"{folder}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    assert kept[3].keys() == {i for i, g in cases.contaminated(kept[2].items(), items).items() if g[1] == 0}
    assert kept[0] != kept[1] != kept[2] != kept[3]
    want = cases.packed_ids(kept[3])
    for rows in (c.STAGES[-1][1](spark, docs, folder).collect(), c.run(spark, folder).collect()):
        assert {(r.doc_id, r.piece): r.length for r in rows} == want


def test_no_rows_go_through(spark, tmp_path):
    import corpus_pipeline as c

    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_without_doc_id_or_that_repeat_one(spark, tmp_path):
    """Only the rows go whose own text is bad; other rows under the same doc_id, or without one, stay."""
    import corpus_pipeline as c

    folder, rng = str(tmp_path), random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    item, clean = text(), [text() for _ in range(6)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    near = clean[0] + " more"
    rows = [(None, f"{clean[0]} {item}"), (None, clean[1]), (None, clean[2]), (5, f"{clean[3]} {item}"), (5, clean[4]), (6, clean[5]), (6, clean[5])]
    docs = cases.documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("dup_kept", c.F.lit("mine")).withColumn("nth", c.F.lit(0))
    left = sorted(t for _, t in pairs(c.decontamination(spark, docs, folder)))
    assert left == sorted([clean[1], clean[2], clean[4], clean[5], clean[5]])
    once = c.exact_dedup(spark, docs, folder)
    assert once.columns == docs.columns and {r.dup_kept for r in once.collect()} == {"mine"}
    assert sorted(t for _, t in pairs(once)) == sorted({t for _, t in rows})
    rows = [(None, near), (None, clean[0]), (7, clean[0] + " other"), (7, clean[1]), (None, clean[2]), (None, ""), (None, None)]
    docs = cases.documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("nth", c.F.lit(0))
    kept = c.near_dedup(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(map(str, pairs(kept))) == sorted(map(str, [(7, clean[0] + " other"), (7, clean[1]), (None, clean[2]), (None, ""), (None, None)]))
