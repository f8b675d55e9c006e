"""Packing, chat formatting and sharding: round trips, laws and hard cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import cases
import numpy as np
from pyspark.sql import functions as F

from tomeatlas.llm.queries import vocabulary

CAPACITY = 256


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def test_tokens_are_those_of_the_tokenizer():
    from tomeatlas.llm.tokens import WordTokenizer

    t = WordTokenizer(vocabulary("word_bpe_49k.json"))
    odd = ["It's DOG'S we'LL '' 'st ?'s 12 ½ x²", "<|startoftext|>hi <|endoftext|>", "İstanbul ΣΑΣ ȺB", "日本 ÉtÉ é", " \n\t", "a b c", "x" * 5000]
    for text in [*odd, *[x for x in cases.sample_texts() if x]]:
        assert [*np.frombuffer(t.encode(text), "<u4"), 0] == ids_of(text)


def test_tokens_of_every_latin_character():
    from tokenizers import Tokenizer

    from tomeatlas.llm.tokens import WordTokenizer

    path = vocabulary("word_bpe_49k.json")
    t, whole = WordTokenizer(path), Tokenizer.from_file(path)
    texts = [text for c in map(chr, range(0x250)) for text in (c, f"a{c}b", f"?{c}1 {c}{c} x")]
    wrong = [x for x in texts if np.frombuffer(t.encode(x), "<u4").tolist() != whole.encode(x, add_special_tokens=False).ids]
    assert not wrong


def test_words_of_letters_are_merged_by_rank(monkeypatch):
    from tokenizers import Tokenizer

    from tomeatlas.llm import tokens

    path = vocabulary("word_bpe_49k.json")
    ranks = tokens.word_ranks(path)
    t, whole = tokens.WordTokenizer(path, ranks), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "etaoinshrdluetaoinsh" + "éüßłžøñªºÿǆɏ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    named = [k.removesuffix("</w>") for k in rng.sample(sorted(whole.get_vocab()), 4000)]
    latin = [text for c in map(chr, range(0x250)) for text in (c, f"a{c}b", f"?{c}1 {c}{c} x")]
    long = ["a" * n for n in range(95, 105)] + ["é" * n for n in (49, 50, 51)] + ["aab" * 33]
    monkeypatch.setattr(tokens, "KNOWN", 50)  # words leave the memory and come again
    for text in [*made, *named, *latin, *long, " ".join(made[:500] + named[:500] + made[:500])]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert len(t.known) + len(t.known.older) <= 50
    fresh, asked = tokens.WordTokenizer(path, ranks), []
    monkeypatch.setattr(fresh, "_whole", lambda word: asked.append(word) or b"")
    fresh.encode("Every wørd, ÉTÉ naïve ownwordmade it's 7")
    assert asked == [",", "'s", "7"]


def test_other_tokenizers_have_no_ranks(tmp_path):
    import json

    from tomeatlas.llm.tokens import word_ranks

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        said = json.load(f)

    def ranks_of(**changed):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(said | {"model": said["model"] | changed}))
        return word_ranks(str(path))

    merges, vocab = said["model"]["merges"], said["model"]["vocab"]
    assert ranks_of()[b"thE"] == vocab["the</w>"]
    assert ranks_of(merges=merges[1:]) is None  # a token that no merge makes
    assert ranks_of(merges=[merges[1], merges[0], *merges[2:]]) is None  # ids out of order
    assert ranks_of(vocab=vocab | {"etz": len(vocab)}) is None
    assert ranks_of(end_of_word_suffix=None) is None


def test_pack(spark):
    from tomeatlas.llm.packing import pack

    docs = cases.documents(spark)
    want = {r.doc_id: ids_of(r.text) for r in docs.select("doc_id", "text").collect()}
    for group, fan_in in ((100_000, 8), (5, 2)):
        rows = pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY, group=group, fan_in=fan_in).collect()
        bins, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
        assert pieces.keys() == want.keys()
        for i, ids in want.items():
            cut = [ids[k : k + CAPACITY] for k in range(0, len(ids), CAPACITY)]
            own = sorted(pieces[i], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, k * CAPACITY, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= CAPACITY
        least = -(-sum(map(len, want.values())) // CAPACITY)
        assert len(bins) <= least * (1.1 if group > 5 else 1.5) + 1
    assert pack(cases.no_documents(spark), vocabulary("word_bpe_49k.json"), CAPACITY).count() == 0


def test_equal_sizes_that_do_not_combine_end_the_tree(spark):
    from tomeatlas.llm.packing import best_fit, pack

    docs = cases.documents(spark, ["a b c d e"] * 9, [1] * 9)
    rows = pack(docs, vocabulary("word_bpe_49k.json"), 10, group=2, fan_in=2).collect()
    assert len(rows) == 9 and len({r.sequence_id for r in rows}) == 9
    assert best_fit(np.array([6, 4, 5, 5, 3, 7]), 10) == [[5, 4], [0, 1], [2, 3]]


def test_escapes_come_back():
    from tomeatlas.llm.chat import CONTROL, escape, unescape

    rng = random.Random(8)
    parts = [*CONTROL, "\\", "<", "[", "s>", "/INST]", " ", "ok"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        shown = escape(text)
        assert unescape(shown) == text
        assert not any(c in shown for c in CONTROL)


def test_chat(spark):
    from tomeatlas.llm.chat import MARKS, conversation_digests, format_turns, read_turns

    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "  ho\n"), (1, 2, "assistant", None), (2, 1, "assistant", said), (2, 0, "system", "<|im_end|>é日"), (2, 0, "system", "<|im_end|>é日"), (None, 5, None, "x"), (3, None, "assistant", "<\\s> </\\s>"), (4, 0, "user", "y" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("nth", "ids", "mask", "learnt", "n_chars")})
    path = vocabulary("byte_bpe_50k.json")
    formatted = format_turns(turns, path)
    read = read_turns(formatted, path)
    got = {r.conv_id: r for r in conversation_digests(read).collect()}
    by = defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, said_there in by.items():
        loss = "".join(t for r, t in said_there if r == "assistant")
        assert got[c].n_turns == len(said_there)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said_there).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    places = [r for r in formatted.where("conv_id = 1").orderBy("nth").collect()]
    assert [r.token_offset for r in places] == [sum(p.n_tokens for p in places[:i]) for i in range(3)]
    assert all(len(r["mask"]) == r.n_tokens == len(r.ids) for r in places)
    assert sum(len(m) for m in MARKS) + len("userhi") == places[0].n_chars
    assert conversation_digests(read_turns(format_turns(turns.where("false"), path), path)).count() == 0


def test_byte_shards(spark):
    from tomeatlas.llm.shards import byte_shards

    texts = cases.sample_texts()
    docs = cases.documents(spark, [*texts[:-3], texts[0], texts[0]], [*range(len(texts) - 3), 0, None])
    for blocks in (1, 5):
        rows = byte_shards(docs, 4, blocks).collect()
        assert len(rows) == len(texts) - 1
        want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.select("doc_id", "text").collect())
        got = sorted((r.shard, r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in rows)
        assert [g[2:] for g in got] == want
        sizes = defaultdict(int)
        for shard in range(4):
            own = [g for g in got if g[0] == shard]
            assert [g[1] for g in own] == list(range(len(own)))
            sizes[shard] = sum(g[5] for g in own)
        total = sum(sizes.values())
        assert all(abs(s - total / 4) <= max(g[5] for g in got) for s in sizes.values())
    assert byte_shards(cases.no_documents(spark), 4).count() == 0


def test_plan_of_sharding_has_no_python(spark):
    from tomeatlas.llm.shards import byte_shards

    plan = byte_shards(cases.documents(spark), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
