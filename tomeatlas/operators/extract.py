"""Places in running text: mentions, ensembles, chunks, context windows, full-text scan, inference."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeatlas import vocab
from tomeatlas.functions.expr import WHITESPACE_RUN, contains_any, items, strip, text
from tomeatlas.functions.themes import lexicon_sentiment, setting_type, validation_reason
from tomeatlas.functions.titles import mentions_city
from tomeatlas.operators.dedup import dedup_first, top_k_per_group
from tomeatlas.operators.joins import geocode_names
from tomeatlas.plans.scratch import materialise

# punctuation taken off both ends of a word
EDGE_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"

# ---- mentions ----


#: Bits of the table that tells whether a run of words may begin or be a name; a power of two, at least 64.
TRIE_BITS = 1 << 22
_CANDIDATES = 50_000  # occurrences held back before they are passed on


def _names(gazetteer: DataFrame) -> DataFrame:
    words = F.split(F.lower(F.trim(F.regexp_replace(text("name"), WHITESPACE_RUN, " "))), " ")
    label = F.col("label") if "label" in gazetteer.columns else F.lit("GPE")
    named = gazetteer.select(F.array_join(words, " ").alias("name_key"), label.alias("label")).filter(F.length("name_key") >= 2)
    return named.groupBy("name_key").agg(F.min("label").alias("label"))


def _trie(names: DataFrame, bits: int) -> tuple[bytes, bytes]:
    """Two tables of ``bits`` bits over CRC-32: runs of words that begin a name, and whole names.

    Their size does not depend on the names. With many names more bits are set and more runs are looked up in vain.
    """
    words = F.split("name_key", " ")
    paths = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    path = names.select("name_key", F.explode(paths).alias("path"))
    spot = path.select(F.crc32("path").bitwiseAND(F.lit(bits - 1)).alias("h"), (F.col("path") == F.col("name_key")).alias("whole"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    rows = spot.groupBy(F.floor(F.col("h") / 64).alias("i")).agg(
        F.bit_or(bit).alias("begins"), F.bit_or(F.when(F.col("whole"), bit).otherwise(F.lit(0))).alias("whole")
    )
    tables = np.zeros((2, bits // 64), "<i8")
    for r in rows.collect():  # at most bits / 64 rows
        tables[:, r["i"]] = r["begins"], r["whole"]
    return tables[0].tobytes(), tables[1].tobytes()


def occurrences(docs: DataFrame, gazetteer: DataFrame, bits: int = TRIE_BITS) -> DataFrame:
    """Every place where a gazetteer name (name, optional label) stands in a document (doc_id, text) as whole words.

    Words are parted by white space, and marks at their ends are taken off. A text is gone through once: a word that begins
    no name is passed over; from one that does, the walk goes on as long as the words so far still begin a name. Which
    runs of words do is told by tables of fixed size, so a gazetteer of any size will do; runs that they let through
    wrongly fall out when whole names are joined. Names may overlap, and a name ends before a word of marks alone. A null text has no words.

    Returns doc_id, name_key, label, surface, word (from 1), start_char and end_char (code points from 0, end behind the last).
    """
    names = materialise(_names(gazetteer), "names")
    begins, whole = _trie(names, bits)
    columns = ["doc_id", "surface", "word", "start_char", "end_char"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Paths(begins, whole)

        def packed(row: list[int], hits: list[tuple], doc_ids: pa.Array) -> pa.RecordBatch:
            surface, word, start, end = zip(*hits)
            arrays = [doc_ids.take(pa.array(row)), pa.array(surface), pa.array(word, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            row, hits = [], []
            for i, s in enumerate(batch["text"]):
                for hit in _walks(s.as_py() or "", look):
                    row.append(i)
                    hits.append(hit)
                    if len(hits) >= _CANDIDATES:
                        yield packed(row, hits, batch["doc_id"])
                        row, hits = [], []
            if hits:
                yield packed(row, hits, batch["doc_id"])

    spans = [T.StructField(c, T.IntegerType()) for c in columns[2:]]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("surface", T.StringType()), *spans])
    runs = docs.select("doc_id", "text").mapInArrow(found, schema)
    return runs.withColumn("name_key", F.lower("surface")).join(names, "name_key").select("doc_id", "name_key", "label", *columns[1:])


_WORD = re.compile(r"\S+")


class _Paths(dict):
    """Whether a word, without its marks, or a run of such words begins a name (1), is one (2), or both (3)."""

    def __init__(self, begins: bytes, whole: bytes, most: int = 1 << 18):
        super().__init__()
        self.begins, self.whole, self.most = begins, whole, most

    def __missing__(self, run: str) -> int:
        key = run.strip(EDGE_MARKS).lower()
        h = crc32(key.encode()) & (len(self.begins) * 8 - 1)
        kind = (self.begins[h >> 3] >> (h & 7) & 1) + 2 * (self.whole[h >> 3] >> (h & 7) & 1) if key else 0
        if len(self) >= self.most:
            self.clear()
        self[run] = kind
        return kind


def _word_starts(s: str, words: list[str]) -> np.ndarray:
    length = np.fromiter(map(len, words), np.int64, len(words))
    if length.sum() + len(words) - 1 == len(s):  # single blanks between the words
        return np.cumsum(length + 1) - length - 1
    return np.array([m.start() for m in _WORD.finditer(s)])


def _walks(s: str, look: _Paths) -> Iterator[tuple[str, int, int, int]]:
    """Runs of words that may be names: surface, word, start, end."""
    words = s.split()
    kinds = [look[w] for w in words]
    if not any(kinds):
        return
    at = _word_starts(s, words)
    first = 2 if s[0].isspace() else 1  # a text that starts with a blank has an empty first word
    for i in np.flatnonzero(kinds).tolist():
        run = x = words[i].strip(EDGE_MARKS)
        kind, j = kinds[i], i
        start = int(at[i]) + words[i].index(x)
        while True:
            if kind & 2:
                yield run, i + first, start, int(at[j]) + words[j].index(x) + len(x)
            j += 1
            if not kind & 1 or j == len(words) or not (x := words[j].strip(EDGE_MARKS)):
                break
            run = f"{run} {x}"
            kind = look[run]


def extract_mentions(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Gazetteer names that occur in documents (doc_id, text) as whole words, see ``occurrences``.

    Per document and name: the first spelling with its word position and span, frequency, label and confidence.
    """
    # spellings are counted first, with fixed-size state, before one of them is chosen per name
    spellings = occurrences(docs, gazetteer).groupBy("doc_id", "name_key", "label", "surface").agg(
        F.min("word").alias("word"), F.min("start_char").alias("start"), F.min("end_char").alias("end"), F.count("*").alias("n")
    )
    found = spellings.groupBy("doc_id", "name_key", "label").agg(
        F.min_by("surface", "word").alias("mention"), F.min("word").alias("first_word"), F.min("start").alias("start_char"),
        F.min_by("end", "word").alias("end_char"), F.sum("n").alias("frequency"),
    )
    capital = F.left("mention", F.lit(1)) != F.lower(F.left("mention", F.lit(1)))
    confidence = (
        F.lit(0.7)
        + F.when(capital, F.lit(0.1)).otherwise(F.lit(0.0))
        + F.when(F.col("label") == "GPE", F.lit(0.1)).otherwise(F.lit(0.0))
        + F.when(F.contains("name_key", F.lit(" ")), F.lit(0.05)).otherwise(F.lit(0.0))
    )
    return found.withColumn("confidence", F.least(F.round(confidence, 2), F.lit(1.0)))


def merge_mentions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two extractors per document and name.

    ``a`` has one row per name (doc_id, mention, confidence, frequency), ``b`` one per occurrence
    (doc_id, mention, confidence, start). Every further agreement adds 0.15 of confidence, up to 1.
    """
    key = F.lower(strip("mention"))
    left = a.select("doc_id", key.alias("name_key"), *[F.col(c).alias(f"a_{c}") for c in ("mention", "confidence", "frequency")])
    right = (
        b.withColumn("name_key", key)
        .groupBy("doc_id", "name_key")
        .agg(F.count("*").alias("hits"), F.min_by(F.struct("mention", "confidence"), "start").alias("b"))
    )
    both = left.join(right, ["doc_id", "name_key"], "full")
    known = F.col("a_mention").isNotNull()
    hits = F.coalesce("hits", F.lit(0))
    base = F.when(known, F.col("a_confidence")).otherwise(F.col("b.confidence"))
    agreements = F.when(known, hits).otherwise(hits - 1)
    return both.select(
        "doc_id", "name_key",
        F.coalesce("a_mention", "b.mention").alias("mention"),
        F.least(F.lit(1.0), base + agreements * 0.15).alias("confidence"),
        F.coalesce("a_frequency", F.lit(1)).cast("bigint").alias("frequency"),
    )


def summarise_entities(entities: DataFrame) -> DataFrame:
    """Occurrences and best score per label and name, regardless of case."""
    return entities.groupBy("label", F.lower("text").alias("text_key")).agg(
        F.count("*").alias("entries"), F.max("score").alias("max_score")
    )


# ---- chunks ----

_FLUSH_CHARS = 1_000_000  # text held back before a batch of chunks is passed on


#: Ends of a chunk, best first; every place counts, also within a run of line ends.
_CHUNK_ENDS = ["\n\n", "\n", ". ", "? ", "! "]


def _chunk_bounds(s: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping stretches. One that does not reach the end of the text stops after the best kind of end that lies
    in its last ``overlap`` characters, at the last such place; the next one starts ``overlap`` characters before that."""
    n = len(s)
    ends = [np.array([m.start() + len(e) for m in re.finditer(f"(?={re.escape(e)})", s)], dtype=int) for e in _CHUNK_ENDS] if n > size else []
    bounds, start = [], 0
    while start + size < n:
        end = start + size
        for e, kind in zip(ends, _CHUNK_ENDS):
            last = np.searchsorted(e, end, side="right") - 1
            if last >= 0 and e[last] - len(kind) >= max(end - overlap, start + 1):
                end = int(e[last])
                break
        bounds.append((start, end))
        start = max(end - overlap, start + 1)  # moves on even where the overlap is as long as the stretch
    return bounds + [(start, n)] if start < n else bounds


def chunk_text(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, start_char, end_char, text) of documents (doc_id, text)."""

    columns = ["doc_id", "chunk", "start_char", "end_char", "text"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def packed(rows: list[tuple]) -> pa.RecordBatch:
                doc, number, start, end, part = zip(*rows)
                spans = [pa.array(x, pa.int32()) for x in (number, start, end)]
                return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc, pa.int64())), *spans, pa.array(part, pa.string())], columns)

            rows, held = [], 0
            for d, t in enumerate(batch["text"]):
                s = t.as_py() or ""
                for i, (a, b) in enumerate(_chunk_bounds(s, size, overlap)):
                    rows.append((d, i, a, b, s[a:b]))
                    held += b - a
                    if held >= _FLUSH_CHARS:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    dtype = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {dtype}, chunk int, start_char int, end_char int, text string"
    return docs.select("doc_id", "text").mapInArrow(chunks, schema)


def dedup_spans(entities: DataFrame) -> DataFrame:
    """One row per (document, name, span) where overlapping chunks found the same mention."""
    keyed = entities.withColumn("name_key", F.lower(strip("mention")))
    return dedup_first(keyed, ["doc_id", "name_key", "start_char", "end_char"], ["chunk"]).drop("name_key")


# ---- context windows ----


_FLUSH_ROWS = 5_000  # passages held back before a batch of them is passed on
_STOP = re.compile(r"[.!?\n]")


def _stops(s: str) -> np.ndarray:
    """Places of the marks that end a sentence or line."""
    return np.array([m.start() for m in _STOP.finditer(s)], dtype=int)


def _windows(s: str, low: str, stops: np.ndarray, name: str, width: int, most: int) -> list[str]:
    """Passages around the first mentions: ``width`` characters on either side, then on to the nearest stop mark.

    The mark before and the blank after it are left out, the mark behind is kept; short passages do not count.
    """
    passages = (_around(s, stops, at, at + len(name), width) for at in _spots(low, name.lower()))
    return list(islice((p for p in passages if len(p) > 20), most))


def _spots(low: str, name: str) -> Iterator[int]:
    """Places of a name in a text, none overlapping the one before."""
    at = low.find(name) if name else -1
    while at >= 0:
        yield at
        at = low.find(name, at + len(name))


def _around(s: str, stops: np.ndarray, start: int, end: int, width: int) -> str:
    before = np.searchsorted(stops, max(0, start - width), side="right") - 1
    behind = np.searchsorted(stops, min(len(s), end + width), side="left")
    left = int(stops[before]) if before >= 0 else 0
    right = int(stops[behind]) + 1 if behind < len(stops) else len(s)
    return s[left + 2 if left else 0 : right].strip()


def context_windows(docs: DataFrame, mentions: DataFrame, width: int = 150, most: int = 3) -> DataFrame:
    """Text around the first mentions of each name: columns of the document and of the mention,
    passage_no and passage.

    Names are packed per document first, so each text is read once, and whatever else documents and
    mentions carry goes along instead of being joined again. A task holds one text and a few thousand passages at a time
    beside its Arrow batch.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = [c for c in mentions.columns if c != "doc_id"]
    packed = mentions.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("_names"))
    joined = docs.join(packed, "doc_id")
    columns = ["doc_id", *carried, *fields, "passage_no", "passage"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, each = batch["_names"].flatten(), batch["_names"].value_lengths().to_numpy()
            behind = np.cumsum(each)
            spelled = named.field("mention")

            def packed(found: list[tuple]) -> pa.RecordBatch:
                doc, name, number, passage = zip(*found)
                doc, name = pa.array(doc, pa.int64()), pa.array(name, pa.int64())
                heads = [batch[c].take(doc) for c in ("doc_id", *carried)] + [named.field(f).take(name) for f in fields]
                return pa.RecordBatch.from_arrays([*heads, pa.array(number, pa.int32()), pa.array(passage, pa.string())], columns)

            found = []
            for i, t in enumerate(batch["text"]):
                s = t.as_py() or ""
                low, stops = s.lower(), _stops(s)
                for j in range(behind[i] - each[i], behind[i]):
                    passages = _windows(s, low, stops, spelled[j].as_py(), width, most)
                    found += [(i, j, number, p) for number, p in enumerate(passages, start=1)]
                    if len(found) >= _FLUSH_ROWS:
                        yield packed(found)
                        found = []
            if found:
                yield packed(found)

    schema = T.StructType(
        [docs.schema[c] for c in ("doc_id", *carried)] + [mentions.schema[f] for f in fields]
        + [T.StructField("passage_no", T.IntegerType()), T.StructField("passage", T.StringType())]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return joined.mapInArrow(windows, schema)


# ---- documents to entries ----


def extract_places(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Entries from documents (doc_id, text, optional title, author, language): mentions, geocoded
    against the gazetteer (name, lon, lat, country, ord), with context windows and sentiment.

    Mentions are written to the shared folder: they feed the geocoding and the windows, and the
    texts are not taken apart twice.
    """
    mentions = materialise(extract_mentions(docs.select("doc_id", "text"), gazetteer), "mentions")
    names = mentions.select(F.col("mention").alias("name")).distinct()
    located = geocode_names(names, gazetteer, "name").withColumnRenamed("name", "mention")
    kept = mentions.join(located, "mention").select(
        "doc_id", "mention", "lon", "lat", "country", "frequency", "confidence"
    )
    meta = (("title", "book_title", "Unknown"), ("author", "author", "Unknown"), ("language", "language", "en"))
    described = docs.select(
        "doc_id", "text",
        *[(F.coalesce(F.col(c), F.lit(v)) if c in docs.columns else F.lit(v)).alias(out) for c, out, v in meta],
    )
    windows = context_windows(described, kept).withColumn("_s", lexicon_sentiment("passage"))
    return windows.select(
        "doc_id", "passage_no", "book_title", "author", F.lit(0).alias("publish_year"),
        F.col("mention").alias("place_name"), "lon", "lat", F.lit("real").alias("place_type"),
        setting_type("frequency").alias("setting_type"), "passage",
        F.col("_s.polarity").alias("polarity"), F.col("_s.emotions").alias("emotions"),
        F.array().cast("array<string>").alias("themes"), "language", text("country").alias("region"), "confidence",
    )


def fulltext_matches(books: DataFrame, cities: list[str] = vocab.FULLTEXT_CITIES) -> DataFrame:
    """Fiction of a full-text catalogue (book_id, title, author, subjects) that names a known city."""
    subjects = F.lower(F.array_join(items("subjects"), " "))
    fiction = contains_any(subjects, vocab.FULLTEXT_FICTION_PARTS) & (text("title") != "")
    matched = mentions_city(F.concat_ws(" ", "title", subjects), cities)
    found = books.filter(fiction).withColumn("matched_city", matched).filter(F.col("matched_city") != "")
    return found.withColumn("subjects", F.slice("subjects", 1, 5))


def fulltext_passages(
    texts: DataFrame, cities: list[str] = vocab.FULLTEXT_CITIES, most: int = 5, shortest: int = 50, longest: int = 1000
) -> DataFrame:
    """First paragraphs of each book (book_id, text) that name a known city, cut to 500 characters."""
    paragraphs = texts.select("book_id", F.posexplode(F.split("text", "\n\n")).alias("paragraph", "p"))
    paragraphs = paragraphs.withColumn("p", strip("p")).filter(F.length("p").between(shortest, longest))
    named = paragraphs.withColumn("city", mentions_city("p", cities)).filter(F.col("city") != "")
    first = top_k_per_group(named, ["book_id"], ["paragraph"], most)
    return first.select("book_id", "paragraph", "rank", "city", F.left("p", F.lit(500)).alias("passage"))


# ---- inference ----


def infer(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], mode: str = "strict", retries: int = 1
) -> DataFrame:
    """Run a batch function over the rows; it returns one JSON text per row.

    Output has ``result``, ``status`` (ok or failed) and ``reason``. Failed rows stay in the output. A batch whose call
    raises, or returns another number of results, is tried again and then halved, down to the single row at fault.
    """
    columns = df.columns

    def answered(batch: pd.DataFrame) -> pd.DataFrame:
        for _ in range(retries + 1):
            try:
                result = list(fn(batch))
                if len(result) != len(batch):
                    raise ValueError(f"{len(result)} results for {len(batch)} rows")
                return batch.assign(result=result, _error=None)
            except Exception as exc:  # noqa: BLE001 - any failure becomes a reason
                fault = f"exception: {exc}"
        if len(batch) <= 1:
            return batch.assign(result=None, _error=fault)
        half = len(batch) // 2
        return pd.concat([answered(batch.iloc[:half]), answered(batch.iloc[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield answered(batch)

    schema = T.StructType([*df.schema.fields, T.StructField("result", T.StringType()), T.StructField("_error", T.StringType())])
    checked = df.mapInPandas(run, schema).withColumn("reason", F.coalesce("_error", validation_reason("result", mode)))
    return checked.withColumn("status", F.when(F.col("reason") == "ok", F.lit("ok")).otherwise(F.lit("failed"))).select(
        *columns, "result", "status", "reason"
    )


def lexicon_results(df: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model: sentiment from the lexicon, themes as they are."""
    scored = df.withColumn("_s", lexicon_sentiment("passage"))
    result = F.to_json(
        F.struct(
            F.col("_s.polarity").alias("polarity"), F.col("_s.emotions").alias("dominant_emotions"),
            items("themes").alias("themes"), F.lit("neutral").alias("literary_mood"),
        )
    )
    return scored.withColumn("result", result).drop("_s")
