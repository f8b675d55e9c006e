"""Classifiers and language model: brute force, held-out accuracy, hard cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def labelled(spark, n=400, seed=4):
    """Prose and junk, some of either with an insult; label 1 for quality and toxic."""
    rng = random.Random(seed)
    syllables = ["ti", "on", "re", "th", "en", "ou", "st", "ha", "er", "an"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts, quality, toxic = [], [], []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(20, 150))]
        good = rng.random() < 0.7
        bad_words = rng.random() < 0.25
        if bad_words:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zqbad", "vile"])
        text = " ".join(w) if good else (" | ".join(w) if rng.random() < 0.5 else " ".join([w[0]] * len(w[:-3]) + w[-3:]).upper() + "!!")
        texts.append(text if good or not bad_words else text + " zqbad vile")
        quality.append(int(good))
        toxic.append(int(bad_words))
    docs = cases.documents(spark, [*texts, None, "", "x" * 100_000, texts[0]], [*range(n), n, n + 1, n + 2, 0])
    rows = [(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic))] + [(0, quality[0], toxic[0]), (None, 1, 1), (5, None, None), (n + 99, 1, 0)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), quality, toxic


def test_classifiers(spark):
    from tomeatlas.llm.labelled import fold
    from tomeatlas.llm.quality import quality_scores
    from tomeatlas.llm.toxicity import toxicity_scores

    docs, labels, quality, toxic = labelled(spark)
    for scores, truth, least in ((quality_scores, quality, 0.97), (toxicity_scores, toxic, 0.97)):
        got = scores(docs, labels, fold("doc_id", 3) != 1, column="score").collect()
        assert len(got) == len(quality) + 4
        assert all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.doc_id < len(truth) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        right = sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held)
        assert right >= least, (scores.__name__, right)
        assert len({r.score for r in got if r.doc_id == 0}) == 1
        assert scores(cases.no_documents(spark), labels).count() == 0
        assert {r.score for r in scores(docs, labels.where("false")).collect()} == {0.5}


def test_interactions_are_learnt():
    from tomeatlas.llm.quality import fit

    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert (0, 2) in [(a, b) for a, b, _ in model.pairs]


def test_features_of_odd_texts():
    from tomeatlas.llm.quality import FEATURES, features

    f = features(pa.array([None, "", " ", "a", "a a a b", "é\n" * 5]))
    assert f.shape == (6, len(FEATURES)) and np.isfinite(f).all()
    assert f[4, FEATURES.index("distinct_words")] == 0.5 and f[4, FEATURES.index("commonest_word")] == 0.75
    assert features(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_elias_fano():
    from tomeatlas.llm.elias_fano import EliasFano

    rng = np.random.default_rng(1)
    for n, universe in ((0, 5), (1, 1), (1000, 10**12), (5000, 6000), (3000, 3001)):
        v = np.sort(rng.choice(universe, n, replace=universe < 10**6 and False)).astype(np.uint64) if n else np.zeros(0, np.uint64)
        ef = EliasFano.of(v, universe)
        assert (ef[np.arange(n)] == v).all()


def test_successor():
    from tomeatlas.llm.elias_fano import Packed

    rng = np.random.default_rng(2)
    for largest in (1, 200, 70_000, 2**40):
        v = rng.integers(0, largest + 1, 3000)
        edge = np.sort(rng.integers(0, 3000, 50))
        for a, b in zip(edge[:-1], edge[1:]):
            v[a:b] = np.sort(v[a:b])
        packed = Packed.of(v, largest)
        assert (packed[np.arange(3000)] == v).all()
        of = rng.integers(0, 49, 800)
        lo, hi, x = edge[of], edge[of + 1], rng.integers(0, largest + 1, 800)
        assert (packed.successor(lo, hi, x) == [a + np.searchsorted(v[a:b], y) for a, b, y in zip(lo, hi, x)]).all()


def test_language_scores(spark):
    from tomeatlas.llm.labelled import fold
    from tomeatlas.llm.language_model import language_scores

    docs = cases.documents(spark)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    tokens = {i: [*cases.words(t, r"[^\x20\x09-\x0d]+"), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two, kinds = Counter(), Counter(), defaultdict(set)
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip([None, *w], w))
            for a, b in zip([None, *w], w):
                kinds[a].add(b)
    total, distinct = sum(one.values()), len(one)
    got = language_scores(docs, fold("doc_id", 7) != 2, order=2).collect()
    assert len(got) == len(texts)
    for r in got:
        w = tokens[r.doc_id]
        alone = [(one[x] + 1) / (total + distinct + 1) for x in w]
        score = 0.0
        for a, b, p in zip([None, *w], w, alone):
            k = len(kinds[a])
            score += math.log10((two[a, b] + k * p) / (one[a] + k) if k else p)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in one for x in w), total)
        assert abs(r.base_score - sum(map(math.log10, alone))) < 1e-6 * len(w)
        assert abs(r.score - score) < 0.02 * len(w)
    assert language_scores(cases.no_documents(spark), F.lit(True)).count() == 0
    unknown = language_scores(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens) for r in unknown} == {(0, 0)}


def test_language_scores_of_higher_orders(spark):
    from tomeatlas.llm.language_model import language_scores

    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefg") for _ in range(draw.randrange(40))) for _ in range(60)]
    tokens = [[None, *t.split(), None] for t in texts]
    for order, part_bytes in ((2, 60), (3, 1 << 20), (3, 200), (4, 60)):  # small parts: common words get parts of their own
        count, kinds, total = Counter(), defaultdict(set), Counter()
        for w in tokens[:50]:
            for i in range(1, len(w)):
                for n in range(1, min(order, i + 1) + 1):
                    g = tuple(w[i - n + 1 : i + 1])
                    count[g] += 1
                    total[g[:-1]] += 1
                    kinds[g[:-1]].add(g[-1])

        def p(g):
            if len(g) == 1:
                return (count[g] + 1) / (total[()] + len(kinds[()]) + 1)
            k = len(kinds[g[:-1]])
            return (count[g] + k * p(g[1:])) / (total[g[:-1]] + k) if k else p(g[1:])

        got = language_scores(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), F.col("doc_id") < 50, order, part_bytes).collect()
        assert len(got) == len(texts)
        for r in got:
            w = tokens[r.doc_id]
            score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(1, len(w)))
            assert abs(r.score - score) < 0.02 * (len(w) - 1), (order, r.doc_id)


def test_rare_insults_count_however_many_ngrams_differ_more(spark):
    from tomeatlas.llm.toxicity import toxicity_scores

    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcdefghijklm") for _ in range(n))
    common, plain = letters(2500), [letters(60) for _ in range(120)]  # about 7,500 n-grams of all common insults
    texts = [f"{p} {common}" for p in plain[:40]] + [f"{p} zyxwvuts" for p in plain[40:44]] + plain[44:]
    asked = {1000: plain[44], 1001: f"{plain[44]} zyxwvuts"}
    docs = spark.createDataFrame([*enumerate(texts), *asked.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 44)) for i in range(len(texts))], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity_scores(docs, labels).where("doc_id >= 1000").collect()}
    assert score[1001] > 1.1 * score[1000]
