"""Importance resampling, quality rules and cross-tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import cases
import pytest
from pyspark.sql import functions as F

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def grams(text, longest):
    w = cases.words(text, ALNUM)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, longest, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, longest)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * n_s) / ((s[b] + 1) * n_t)))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        g = grams(x, longest)
        weight = sum(gain(bucket(y)) for y in g)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(cases.words(x, ALNUM))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        drawn[(*r[:4], rank)] += 1
    rest = Counter(r[:4] for r in rows) - Counter(k[:4] for k in drawn.elements())
    return drawn + Counter({(*k, None): n for k, n in rest.items()})


@pytest.mark.parametrize(("longest", "buckets", "percent", "least", "pivots"), [(1, 10_000, 10, 20, 15), (3, 7, 50, 0, 2), (2, 100, 100, 3, 1), (1, 50, 0, 20, 4)])
def test_resampling(spark, longest, buckets, percent, least, pivots):
    from tomeatlas.llm.resampling import importance_resample

    texts = [*cases.sample_texts(), "x" * 70_000 + " y", "a" * 64 + " " + "b" * 65]
    ids = [*range(100, 98 + len(texts)), None, 100]  # one without id, one twice
    docs = cases.documents(spark, texts, ids)
    target = ["w1 w2 w3 " * 5, None, "", "ÉTÉ w1", texts[3]]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance_resample(docs, items, percent, least, longest, buckets, 7, pivots)
    assert Counter(map(tuple, got.collect())) == resampled(list(zip(ids, texts)), target, longest, buckets, percent, least, 7)


def test_resampling_of_equal_rows_and_none(spark):
    from tomeatlas.llm.resampling import importance_resample

    docs = cases.documents(spark, ["a b c"] * 40, [5] * 40)
    got = importance_resample(docs, docs.where("false"), 30, 1, pivots=3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13)) and len(got) == 40
    assert importance_resample(cases.no_documents(spark), docs).count() == 0


def facts(text):
    text = text or ""
    w = cases.words_as_written(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(cases.BLANKS)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(re.findall("[A-Z]", text)), len(lines), len(lines) - len(set(lines)), len(repeated))


def test_text_facts(spark):
    from tomeatlas.llm.quality_rules import text_facts

    texts = [*cases.sample_texts(), "a b c\na b c\n \n\n", "a a a a", "a a a", "A#*$%&|<>\n\n| |", "l\nl\nl ", "é é é é é", "x\ty\nx\ty\n"]
    docs = cases.documents(spark, texts)
    got = {r[0]: tuple(r[1:]) for r in text_facts(docs).collect()}
    assert got == {100 + i: facts(t) for i, t in enumerate(texts)}
    assert text_facts(cases.no_documents(spark)).count() == 0


def test_binomial_tail():
    from tomeatlas.llm.quality_rules import binomial_tail

    for n, p in ((1, 0.3), (40, 0.01), (200, 0.05)):
        q = Fraction(p)
        for x in range(0, n + 1, max(1, n // 7)):
            exact = sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(x + 1))
            assert abs(binomial_tail(x, n, p) - float(exact)) < 1e-9
    assert binomial_tail(0, 10**9, 0.01) == 0.0 and binomial_tail(5, 5, 0.5) == 1.0


def rule_values(f):
    words, chars, symbols, upper, lines, dup, rep = f
    out = {"symbols": 1000 * symbols // max(chars, 1), "capitals": 1000 * upper // max(chars, 1), "repeated_lines": 1000 * dup // max(lines, 1)}
    out |= {"repeated_words": 1000 * rep // max(words, 1), "long_words": 100 * chars // max(words, 1)}
    return {k: min(v, 5000) for k, v in out.items()}


def cutoffs(rows, alpha, delta):
    """Of (stratum, id, label, facts): naive search over all candidates."""
    able = [(s, i, y, rule_values(f)) for s, i, y, f in rows if f[0] >= 50 and 100 * f[6] <= 50 * f[0]]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 0
    tests, found = set(), {}
    options = defaultdict(list)
    for s in {r[0] for r in able}:
        own = [r for r in able if r[0] == s]
        for rule in own[0][3]:
            bad, good, held = ([v[rule] for _, i, y, v in own if y == want and fold(i) == p] for want, p in ((0, True), (1, True), (1, False)))
            for c in set(bad) if held else ():
                tests.add((s, rule))
                hits = lambda v: sum(x >= c for x in v)  # noqa: E731, B023
                options[s, rule].append((hits(bad) / len(bad) - 10 * hits(good) / max(len(good), 1), c, hits(held), len(held)))
    for key, own in options.items():
        passed = []
        for worth, c, x, n in own:
            q = Fraction(alpha / 5)
            p = sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(x + 1))
            if worth > 0 and p <= delta / len(tests):
                passed.append((round(worth, 9), c))
        if passed:
            found[key] = max(passed)[1]
    return found


def labelled_texts(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.75
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(52, 70))]
        if not good:
            w = [x + "#%" for x in w] if i % 2 else [x.upper() for x in w]
        elif rng.random() < 0.004:
            w[0] = "#" * 60
        rows.append((i, " ".join(w), "en" if i % 3 else (None if i % 2 else "de"), int(good)))
    return rows


def test_rules(spark):
    from tomeatlas.llm.quality_rules import certified_cutoffs, judged_documents, text_facts

    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t, s, s, s) for i, t, s, _ in rows], "doc_id long, text string, lang string, rule string, label string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, _, y in rows] + [(None, 1, 0), (3, None, 0), (rows[0][0], 0, 1)], "doc_id long, quality int, toxic int")
    measured = text_facts(docs.select("doc_id", F.col("lang").alias("stratum"), "text"), ["doc_id", "stratum"]).join(labels.groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id")
    for alpha, delta in ((0.2, 0.2), (0.3, 0.05)):
        got = {(r.stratum, r.rule): r.cutoff for r in certified_cutoffs(measured, alpha, delta).collect()}
        want = cutoffs([(s, i, y, facts(t)) for i, t, s, y in rows], alpha, delta)
        assert got == want and ("en", "symbols") in want and ("en", "capitals") in want
    judged = {r.doc_id: r for r in judged_documents(docs, labels, alpha=0.2, delta=0.2).collect()}
    want = cutoffs([(s, i, y, facts(t)) for i, t, s, y in rows], 0.2, 0.2)
    for i, t, s, _ in rows:
        broken = [rule for rule, v in rule_values(facts(t)).items() if v >= want.get((s, rule), 10**9)]
        assert (judged[i].broken, judged[i].kept, judged[i].base_failed) == (broken, not broken, False)
    for s in ("en", "de", None):
        good = [judged[i].kept for i, _, x, y in rows if x == s and y]
        assert good.count(False) <= 0.2 * len(good)
    assert not any(judged[i].kept for i, _, x, y in rows if x == "en" and not y)


def test_rules_of_odd_rows(spark):
    from tomeatlas.llm.quality_rules import judged_documents

    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = judged_documents(docs, none).collect()
    for r in got:
        assert r.kept != r.base_failed and not r.broken
    texts = {i: t for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert {r.doc_id: r.base_failed for r in got} == {i: facts(t)[0] < 50 or 100 * facts(t)[6] > 50 * facts(t)[0] for i, t in texts.items()}
    twice = cases.documents(spark, ["a b", "a b", None], [None, None, None])
    assert [r.kept for r in judged_documents(twice, none).collect()] == [False] * 3
    assert judged_documents(cases.no_documents(spark), none).count() == 0


def aligned(texts):
    """Of each text the two id lists and its slices, encoded whole."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from tomeatlas.llm.cross_tokens import _byte_letters
    from tomeatlas.llm.queries import vocabulary

    a, b, letters = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), _byte_letters()
    a.encode_special_tokens = True
    out = []
    for t in texts:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        raw_x = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        raw_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or not b"".join(raw_x) == (" " + t).encode() == b"".join(raw_y):
            out.append(([], [], []))
            continue
        ends = [[sum(map(len, raw[: i + 1])) for i in range(len(raw))] for raw in (raw_x, raw_y)]
        groups, i, j = [], 0, 0
        for e in ends[0]:
            if e in set(ends[1]):
                k, m = ends[0].index(e) + 1, ends[1].index(e) + 1
                groups.append((x[i:k], y[j:m]))
                i, j = k, m
        out.append((x, y, groups))
    return out


def odd_texts():
    rng = random.Random(8)
    alphabet = [*"abcABC   \n\n\t'sé日ñ,.;)(}{123", "​", "😀", "</s>", "<|endoftext|>", "'ll", " the", "ing", "\r", " ", "▁", "́", "\x1c", "\x85", "　", " \n", "  "]
    mixed = ["".join(rng.choice(alphabet[: 26 if n % 2 else None]) for _ in range(rng.randrange(1, 30))) for n in range(150)]
    plain = [" ".join(rng.choice(["the", "Bank.", "of\nnew", "naïve", "2024,", "don't"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return [*mixed, *plain, *plain[:3], None, "", " ", "\n", "a▁b", "x" * 2000, "é" * 500, "the " * 300, "a\r\nb", "<s>"]


def test_alignment(spark):
    from tomeatlas.llm.cross_tokens import linked_tokens, pair_counts, slices
    from tomeatlas.llm.queries import vocabulary

    texts = odd_texts()
    docs = cases.documents(spark, texts)
    want = aligned(texts)
    links = [[(x[-1], y[-1]) for x, y in groups] for _, _, groups in want]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r for r in linked_tokens(docs, *paths).withColumn("slices", slices("groups")).collect()}
    assert len(got) == len(texts)
    for i, ((x, y, groups), own) in enumerate(zip(want, links)):
        r = got[100 + i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(x), len(y), len(groups), len(own)), repr(texts[i])
        assert [(list(s.a), list(s.b)) for s in r.slices] == groups
        assert (r.n_best, r.count_sum) == (sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own))
    assert {(r.a, r.b): (r.n, r.highest) for r in pair_counts(docs, *paths).collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}
    assert linked_tokens(cases.no_documents(spark), *paths).count() == 0
    twice = linked_tokens(cases.documents(spark, ["ab cd"] * 2, [None, None]), *paths).collect()
    assert twice[0] == twice[1] and twice[0].doc_id is None and twice[0].count_sum == 2 * twice[0].n_links


def test_alignment_with_a_full_memory(monkeypatch):
    from tomeatlas.llm import cross_tokens
    from tomeatlas.llm.queries import vocabulary

    monkeypatch.setattr(cross_tokens, "KNOWN", 5)
    monkeypatch.setattr(cross_tokens, "LONG", 3)
    aligner = cross_tokens.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    texts = odd_texts()
    want = [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups) for _, _, groups in aligned(texts)]
    for first in range(0, len(texts), 20):
        codes = aligner.codes(texts[first : first + 20])
        assert [";".join(aligner.text[c] for c in own) for own in codes] == want[first : first + 20]
    assert aligner.kept == 5


def test_whole_text_tokens_equal_those_of_stretches(monkeypatch):
    from tomeatlas.llm import cross_tokens
    from tomeatlas.llm.queries import vocabulary

    aligner = cross_tokens.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert aligner.cuttable and aligner.a.ranks is not None
    texts = [t for t in odd_texts() if t]
    cut = [";".join(aligner.text[c] for c in own) for own in aligner.codes(texts)]
    aligner.cuttable = False
    assert [";".join(aligner.text[c] for c in own) for own in aligner.codes(texts)] == cut


def test_new_stretches_are_added_at_once():
    """Few calls for thousands of different stretches, with the tokens of whole texts; blanks, odd signs and null among them."""
    import sys

    from tomeatlas.llm import cross_tokens
    from tomeatlas.llm.queries import vocabulary

    words = [f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(1500) for w in ("ren", "éa", "东")]
    texts = [" ".join(words[i : i + 50]) + "\n" * (i % 3) for i in range(0, len(words), 50)] + ["a  b\n\n c ", "\n", " ", "", None, "ﬁ x", "a\x1fb", "a b", "\t\tx \n"]
    aligner = cross_tokens.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    want = []
    for t in texts:
        aligner._forget()
        want.append([aligner.text[c] for c in aligner._whole(t)] if t else [])
    aligner._forget()
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        codes = aligner.codes(texts)
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words)
    assert [";".join(aligner.text[c] for c in own) for own in codes] == [";".join(w) for w in want]
