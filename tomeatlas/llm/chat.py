"""Chat formatting at the level of tokens: segments are encoded alone and joined by reserved ids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of common chat templates; one that occurs in a text gets ESCAPE after its first character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
#: Reserved ids after the tokenizer's own: start of a turn, end of its role, end of the turn.
MARKS = {"<|im_start|>": 0, "<|sep|>": 1, "<|im_end|>": 2}

#: A control string's first character, then any escapes, then the rest: one escape more hides it, one less shows it.
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(?=(?:{re.escape(ESCAPE)})*{re.escape(c[1:])})" for c in CONTROL))
_HIDDEN = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}(?=(?:{re.escape(ESCAPE)})*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """The text without any control string; ``unescape`` gives it back."""
    return _PLAIN.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[0][0], text)


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def format_turns(turns: DataFrame, tokenizer_path: str, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Token ids and loss mask of every turn, with its place in its conversation.

    A turn becomes: start mark, ids of the role, separator mark, ids of the text, end mark. Role and text are encoded
    apart, after control strings in them are escaped, so no text can make a mark and no token spans a border. The mask
    is the running sum of +1 where a learnt text starts and -1 where it ends. ``token_offset`` and
    ``char_offset``, running sums over the turns before it, place a turn in its conversation; the ids of a
    conversation are those of its turns one after the other, so no conversation is ever gathered.

    Turns are ordered by turn, then by role and text (null first). A null role or text counts as empty; rows with a
    null conv_id form one conversation; repeated rows stay repeated turns. An empty table gives no rows. Further
    columns are not read.

    Returns conv_id, turn, nth (from 0), ids, mask (bytes 0 and 1), n_tokens, n_chars (of the formatted turn),
    token_offset, char_offset.
    """
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    learnt = frozenset(learn)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        base = t.get_vocab_size()
        start, sep, end = (base + i for i in MARKS.values())
        marks_chars = sum(map(len, MARKS))
        for batch in batches:
            roles, texts = batch["role"].to_pylist(), batch["text"].to_pylist()
            shown = [escape(r) for r in roles], [escape(x) for x in texts]
            coded = [t.encode_batch(x, add_special_tokens=False) for x in shown]
            ids, masks, n_chars = [], [], []
            for i, (r, x) in enumerate(zip(*coded)):
                turn = np.array([start, *r.ids, sep, *x.ids, end], np.int32)
                edge = np.zeros(len(turn) + 1, np.int8)
                if roles[i] in learnt:
                    edge[len(r.ids) + 2] += 1
                    edge[len(turn) - 1] -= 1
                ids.append(turn)
                masks.append(np.cumsum(edge[:-1], dtype=np.int8).tobytes())
                n_chars.append(marks_chars + len(shown[0][i]) + len(shown[1][i]))
            yield pa.record_batch({
                "conv_id": batch["conv_id"], "turn": batch["turn"], "role": batch["role"], "text": batch["text"],
                "ids": pa.array(ids, pa.list_(pa.int32())), "mask": pa.array(masks, pa.binary()),
                "n_chars": pa.array(n_chars, pa.int64()),
            })

    coded = plain.mapInArrow(encoded, "conv_id long, turn long, role string, text string, ids array<int>, mask binary, n_chars long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("ids").cast("long")
    return coded.select(
        "conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("nth"), "ids", "mask", n.alias("n_tokens"), "n_chars",
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("token_offset"), F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("char_offset"),
    )


def read_turns(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Role, text and learnt text of every turn, read back from ids and mask; other columns stay as they are."""
    names = formatted.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        base = t.get_vocab_size()
        sep = base + MARKS["<|sep|>"]
        for batch in batches:
            parts: list[list[int]] = []
            masks = batch["mask"].to_pylist()
            for ids, mask in zip(batch["ids"], masks):
                turn = ids.values.to_numpy()
                cut = int(np.flatnonzero(turn == sep)[0])
                under = np.frombuffer(mask, np.int8).astype(bool)
                parts += [turn[1:cut].tolist(), turn[cut + 1 : -1].tolist(), turn[under].tolist()]
            texts = [unescape(x) for x in t.decode_batch(parts, skip_special_tokens=False)]
            yield pa.record_batch([*[batch[c] for c in names], *[pa.array(texts[i::3], pa.string()) for i in range(3)]], names=[*names, "role", "text", "learnt"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema)
    return formatted.mapInArrow(decoded, f"{kinds}, role string, text string, learnt string")


def conversation_digests(read: DataFrame) -> DataFrame:
    """Digests of whole conversations, over turns sorted by conversation and place.

    Rows stream by in order, so a conversation of any length takes no more memory than one batch.
    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    import hashlib

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, out = None, []

        def closed():
            conv, n, turns, chars, loss, shown = now
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": shown}

        for batch in batches:
            for conv, role, text, learnt, n_chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text", "learnt", "n_chars"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += n_chars
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    rows = read.select("conv_id", "nth", "role", "text", "learnt", "n_chars").repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return rows.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
