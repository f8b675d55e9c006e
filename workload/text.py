"""Places in running text over documents and conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions import themes
from tomeatlas.functions.expr import WHITESPACE_RUN
from tomeatlas.operators import extract
from workload.registry import query
from workload.tables import _BLANKS as _BLANKS_SQL
from workload.tables import has_any, joined, places, sql_list, strip, table

_MARKS = extract.EDGE_MARKS.replace("'", "''")


def _sql_tokens(x: str) -> str:
    return f"[trim(w, '{_MARKS}') for w in regexp_split_to_array({x}, '{_BLANKS_SQL}')]"


_BENCH_TOKENS = _sql_tokens("text")
GAZETTEER_SQL = f"""bt as (select {_BENCH_TOKENS} as w from benchmark),
 gz as (select distinct lower(x) as name from (select unnest(w) as x from bt) where length(x) >= 4 and lower(x[1]) <> x[1]
  union select distinct lower(w[1] || ' ' || w[2]) from bt where length(w[1]) > 0 and length(w[2]) > 0)"""


def _tokens():
    return F.transform(F.split("text", WHITESPACE_RUN), lambda w: F.btrim(w, F.lit(extract.EDGE_MARKS)))


def documents(spark, d):
    return table(spark, d, "documents")


def gazetteer(spark, d):
    """Capitalised words of the benchmark texts and their first two words, with made-up points."""
    tokens = _tokens()
    bench = table(spark, d, "benchmark").select(tokens.alias("w"))
    words = bench.select(F.explode("w").alias("x")).filter((F.length("x") >= 4) & (F.lower(F.left("x", F.lit(1))) != F.left("x", F.lit(1))))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    pairs = bench.filter((first != "") & (second != "")).select(F.concat_ws(" ", first, second).alias("x"))
    names = words.unionByName(pairs).select(F.lower("x").alias("name")).distinct()
    h = F.pmod(F.crc32("name"), F.lit(17000))
    return names.select(
        "name", (h / 100.0 - 85).alias("lon"), (h / 200.0 - 40).alias("lat"), F.lit("Nowhere").alias("country"),
        F.crc32("name").alias("ord"),
    )


# a word's span: what stands before it, words and blanks, then the marks taken off its left
MENTIONS_SQL = f"""{GAZETTEER_SQL}, dt as (select doc_id, regexp_split_to_array(text, '{_BLANKS_SQL}') as r, regexp_extract_all(text, '{_BLANKS_SQL}') as g from documents),
 raw as (select doc_id, unnest(r) as r, unnest(g) as g, generate_subscripts(r, 1) as i from dt),
 tok as (select doc_id, i, trim(r, '{_MARKS}') as x, coalesce(sum(length(r) + coalesce(length(g), 0)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + length(r) - length(ltrim(r, '{_MARKS}')) as s from raw),
 nxt as (select *, lead(x) over (partition by doc_id order by i) as y, lead(s) over (partition by doc_id order by i) as ys from tok where true),
 cand as (select doc_id, i, x as surface, s as start_char, s + length(x) as end_char from tok where x <> '' union all select doc_id, i, x || ' ' || y, s, ys + length(y) from nxt where x <> '' and y is not null),
 hits as (select doc_id, lower(surface) as name_key, surface, i, start_char::int as start_char, end_char::int as end_char from cand where lower(surface) in (select name from gz)),
 mentions as (select doc_id, name_key, arg_min(surface, i) as mention, min(i) as first_word, arg_min(start_char, i) as start_char, arg_min(end_char, i) as end_char, count(*) as frequency from hits group by 1, 2)"""


@query(
    "k1_occurrences",
    f"with {MENTIONS_SQL} select doc_id, name_key, surface, i as word, start_char, end_char from hits",
)
def _(spark, d):
    return extract.occurrences(documents(spark, d), gazetteer(spark, d)).drop("label")


@query(
    "k1_extract_mentions",
    f"""with {MENTIONS_SQL} select doc_id, name_key, mention, first_word, start_char, end_char, frequency, round(0.8::double + case when lower(mention[1]) <> mention[1] then 0.1 else 0 end + case when contains(name_key, ' ') then 0.05 else 0 end, 2) as confidence from mentions""",
)
def _(spark, d):
    found = extract.extract_mentions(documents(spark, d), gazetteer(spark, d))
    return found.select("doc_id", "name_key", "mention", "first_word", "start_char", "end_char", "frequency", "confidence")


@query(
    "k2_merge_mentions",
    f"""with {MENTIONS_SQL}, a as (select * from mentions where frequency > 1),
    b as (select doc_id, name_key, count(*) as n, arg_min(surface, i) as mention from hits where length(name_key) % 2 = 0 group by 1, 2)
    select doc_id, name_key, coalesce(a.mention, b.mention) as mention, round(least(1.0, case when a.mention is not null then 0.8 + 0.15 * coalesce(n, 0) else 0.6 + 0.15 * (n - 1) end), 4)::double as confidence,
     coalesce(a.frequency, 1) as frequency from a full join b using (doc_id, name_key)""",
)
def _(spark, d):
    docs, names = documents(spark, d), gazetteer(spark, d)
    first = extract.extract_mentions(docs, names).filter("frequency > 1").withColumn("confidence", F.lit(0.8))
    # the second extractor reports every occurrence
    every = extract.occurrences(docs, names).filter(F.length("name_key") % 2 == 0)
    second = every.select("doc_id", F.col("surface").alias("mention"), F.lit(0.6).alias("confidence"), F.col("word").alias("start"))
    both = extract.merge_mentions(first, second)
    return both.withColumn("confidence", F.round("confidence", 4))


_LAST_END = "case when start_char + 2000 >= n then n when contains(w, chr(10) || chr(10)) then start_char + 1800 + length(w) - strpos(reverse(w), reverse(chr(10) || chr(10))) + 1 when contains(w, chr(10)) then start_char + 1800 + length(w) - strpos(reverse(w), reverse(chr(10))) + 1 when contains(w, '. ') then start_char + 1800 + length(w) - strpos(reverse(w), reverse('. ')) + 1 when contains(w, '? ') then start_char + 1800 + length(w) - strpos(reverse(w), reverse('? ')) + 1 when contains(w, '! ') then start_char + 1800 + length(w) - strpos(reverse(w), reverse('! ')) + 1 else start_char + 2000 end"
_NEXT_CHUNK = "select doc_id, s, n, chunk, start_char, {end} as end_char from (select *, substr(s, start_char + 1801, 200) as w from ({rows}))"


@query(
    "k3_chunk_text",
    f"""with recursive d as (select doc_id, text as s, length(text) as n from documents where length(text) > 0),
    c as ({_NEXT_CHUNK.format(end=_LAST_END, rows="select *, 0 as chunk, 0 as start_char from d")}
     union all {_NEXT_CHUNK.format(end=_LAST_END, rows="select doc_id, s, n, chunk + 1 as chunk, greatest(end_char - 200, start_char + 1) as start_char from c where end_char < n")})
    select doc_id, chunk, start_char, end_char, substr(s, start_char + 1, end_char - start_char) as text from c""",
)
def _(spark, d):
    return extract.chunk_text(documents(spark, d))


# places of names and of stop marks from the lengths of what lies between them
WINDOWS_SQL = f"""p as (select m.doc_id, name_key, mention, length(mention) as l, length(text) as n, string_split(lower(text), lower(mention)) as parts from mentions m join documents using (doc_id) where frequency > 1),
 seen as (select *, unnest(range(1, len(parts))) as i from p),
 found as (select doc_id, name_key, mention, n, cast(list_sum([length(x) for x in parts[1:i]]) + (i - 1) * l as bigint) as spot, l from seen),
 seg as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as i, len(x) as k from (select doc_id, string_split_regex(text, '[.!?\\n]') as x from documents)),
 stops as (select doc_id, cast(sum(length(x)) over (partition by doc_id order by i) + i - 1 as bigint) as pos, i, k from seg), marks as (select doc_id, pos from stops where i < k),
 bounds as (select *, greatest(0, spot - 150) as l0, least(n, spot + l + 150) as r0 from found),
 cut as (select b.doc_id, name_key, mention, spot, n, x.pos as lpos, y.pos as rpos from bounds b asof left join marks x on b.doc_id = x.doc_id and b.l0 >= x.pos asof left join marks y on b.doc_id = y.doc_id and b.r0 <= y.pos),
 passages as (select doc_id, name_key, mention, spot, {strip("substr(text, case when coalesce(lpos, 0) = 0 then 1 else lpos + 3 end, greatest(0, coalesce(rpos + 1, n) - case when coalesce(lpos, 0) = 0 then 0 else lpos + 2 end))")} as passage from cut join documents using (doc_id)),
 windows as (select doc_id, name_key, mention, row_number() over (partition by doc_id, name_key order by spot) as passage_no, passage from passages where length(passage) > 20)"""


@query("k4_context_windows", f"with {MENTIONS_SQL}, {WINDOWS_SQL} select doc_id, name_key, mention, passage_no, passage from windows where passage_no <= 3")
def _(spark, d):
    docs = documents(spark, d)
    mentions = extract.extract_mentions(docs, gazetteer(spark, d)).filter("frequency > 1")
    return extract.context_windows(docs.select("doc_id", "text"), mentions.select("doc_id", "name_key", "mention"))


_LEXICON = vocab.EMOTION_WORDS
_EMOTED_SQL = f"select ord, passage || ' ' || array_to_string({sql_list([w for ws in _LEXICON.values() for w in ws[:3]])}[1 + cast(ord % 7 as int):cast(ord % 20 as int)], ' ') as t from places"
_COUNTS = ", ".join(f"len(list_intersect(w, {sql_list(ws)})) as {n}" for n, ws in _LEXICON.items())
_RANKED = "[" + ", ".join(f"{{'s': -{n}, 'i': {i}, 'n': '{n}'}}" for i, n in enumerate(_LEXICON)) + "]"


@query(
    "k5_lexicon_sentiment",
    f"""with e as ({_EMOTED_SQL}), s as (select ord, list_distinct(regexp_split_to_array(lower(t), '{_BLANKS_SQL}')) as w from e), c as (select ord, {_COUNTS} from s)
    select ord, round((joy + wonder - sadness - fear - anger) / greatest(joy + wonder + sadness + fear + anger + nostalgia + longing, 1), 2) as polarity,
     coalesce(nullif(array_to_string([x.n for x in list_sort({_RANKED}) if x.s < 0][1:3], '|'), ''), 'neutral') as emotions from c""",
)
def _(spark, d):
    words = F.array(*[F.lit(w) for ws in _LEXICON.values() for w in ws[:3]])
    first, last = (F.col("ord") % 7).cast("int") + 1, (F.col("ord") % 20).cast("int")
    picked = F.slice(words, first, F.greatest(last - first + 1, F.lit(0)))
    rows = places(spark, d).select("ord", F.concat_ws(" ", "passage", F.array_join(picked, " ")).alias("t"))
    s = rows.withColumn("s", themes.lexicon_sentiment("t"))
    return s.select("ord", F.col("s.polarity").alias("polarity"), joined("s.emotions").alias("emotions"))


@query(
    "k7_setting_type",
    f"with {MENTIONS_SQL} select doc_id, name_key, case when frequency >= 5 then 'primary' when frequency >= 2 then 'secondary' else 'mentioned' end as setting from mentions",
)
def _(spark, d):
    found = extract.extract_mentions(documents(spark, d), gazetteer(spark, d))
    return found.select("doc_id", "name_key", themes.setting_type("frequency").alias("setting"))


@query("k8_extract_places")
def _(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.col("source").alias("author"), F.col("lang").alias("language"))
    return extract.extract_places(docs, gazetteer(spark, d))


_WORDS = ["the", "que", "ist", "une", "con"]
_ANY = r"(?:^|[^\p{L}\p{N}_])(" + "|".join(_WORDS) + r")(?:$|[^\p{L}\p{N}_])"


@query(
    "k9_fulltext_matches",
    f"""with b as (select doc_id as book_id, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') as title, [lang, case when doc_id % 3 = 0 then 'Short Stories' else 'Essays' end] as subjects from documents)
    select book_id, regexp_extract(concat_ws(' ', title, lower(array_to_string(subjects, ' '))), '(?i){_ANY}', 1) as matched_city from b
    where {has_any("lower(array_to_string(subjects, ' '))", vocab.FULLTEXT_FICTION_PARTS)} and title <> '' and regexp_matches(concat_ws(' ', title, lower(array_to_string(subjects, ' '))), '(?i){_ANY}')""",
)
def _(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("Short Stories")).otherwise(F.lit("Essays"))
    title = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    books = documents(spark, d).select(F.col("doc_id").alias("book_id"), title.alias("title"), F.array("lang", kind).alias("subjects"))
    return extract.fulltext_matches(books, _WORDS).select("book_id", "matched_city")


@query(
    "k9_fulltext_passages",
    f"""with p as (select doc_id as book_id, unnest(p) as p, generate_subscripts(p, 1) - 1 as paragraph from (select doc_id, string_split(replace(text, '\n', '\n\n'), '\n\n') as p from documents)),
    s as (select book_id, paragraph, regexp_replace(regexp_replace(p, '^{_BLANKS_SQL}', ''), '{_BLANKS_SQL}$', '') as p from p),
    n as (select *, regexp_extract(p, '(?i){_ANY}', 1) as city, row_number() over (partition by book_id order by paragraph) as rank from s where length(p) between 50 and 1000 and regexp_matches(p, '(?i){_ANY}'))
    select book_id, paragraph, rank, city, p[1:500] as passage from n where rank <= 5""",
)
def _(spark, d):
    texts = documents(spark, d).select(F.col("doc_id").alias("book_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return extract.fulltext_passages(texts, _WORDS)


def scripted_model(batch: pd.DataFrame) -> pd.Series:
    """Stands in for a model: grounded output for most rows, thin output for short passages."""

    def answer(passage: str | None) -> str:
        grounded = ["war_trauma", "labor_exploitation", "village_memory_loss", "family_conflict"]
        themes_out = grounded if len(passage or "") > 100 else grounded[:2]
        return json.dumps(
            {"polarity": -0.4, "dominant_emotions": ["grief", "dread", "hope"], "themes": themes_out, "literary_mood": "quiet_dread"}
        )

    return batch["passage"].map(answer)


@query(
    "k10_infer",
    """select ord, case when length(passage) > 100 then 'ok' else 'failed' end as status, case when length(passage) > 100 then 'ok' else 'themes size invalid' end as reason from places""",
)
def _(spark, d):
    rows = places(spark, d).select("ord", "id", "passage")
    return extract.infer(rows, scripted_model).select("ord", "status", "reason")


@query(
    "k10_lexicon_results",
    f"""with s as (select conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '{_BLANKS_SQL}')) as w from conversations), c as (select conv_id, turn, {_COUNTS} from s),
    r as (select conv_id, turn, round((joy + wonder - sadness - fear - anger) / greatest(joy + wonder + sadness + fear + anger + nostalgia + longing, 1), 2) as polarity,
     [x.n for x in list_sort({_RANKED}) if x.s < 0][1:3] as emotions from c)
    select conv_id, turn, to_json({{polarity: polarity, dominant_emotions: case when len(emotions) = 0 then ['neutral'] else emotions end, themes: cast([] as varchar[]), literary_mood: 'neutral'}}) as result from r""",
)
def _(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("passage"), F.array().cast("array<string>").alias("themes"))
    return extract.lexicon_results(talk).select("conv_id", "turn", "result")
