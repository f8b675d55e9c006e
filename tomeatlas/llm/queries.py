"""One registered query for each operator, over whole tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_decontamination",
    r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
bw AS (
  SELECT item_id, list_filter(string_split_regex(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN n ON n.doc_id = dw.doc_id
""",
)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.winnowing import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.packing import pack

    return pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op4_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS r, count(*) OVER (PARTITION BY norm) AS group_size,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g
""",
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.radix_dedup import exact_duplicates

    found = exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.col("dup_keep_id").alias("keep_id"), F.col("dup_size").alias("group_size"), F.col("dup_kept").alias("kept"), F.col("dup_sha256").alias("text_sha256"))


_CONTROL = r"<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>"


@query(
    "op9_chat_formatting",
    f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, 29 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id
""",
)
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.chat import conversation_digests, format_turns, read_turns

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = vocabulary("byte_bpe_50k.json")
    return conversation_digests(read_turns(format_turns(rows.unionByName(more), path), path))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.shards import byte_shards

    dealt = byte_shards(table(spark, folder, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.labelled import fold
    from tomeatlas.llm.quality import quality_scores

    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.labelled import fold
    from tomeatlas.llm.toxicity import toxicity_scores

    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, folder, "labels"), fold("doc_id", 4) != 2)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op7_ngram_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) d LEFT JOIN n ON n.doc_id = d.doc_id
""",
)
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, folder, "documents"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.labelled import fold
    from tomeatlas.llm.language_model import language_scores

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    scored = language_scores(docs, fold("doc_id", 7) != 2, order=3)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.line_dedup import without_repeated_lines

    cleaned = without_repeated_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query(
    "op11_importance_resampling",
    r"""
WITH crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT side, id, w, count(*) AS n FROM (
    SELECT side, id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM texts)
  GROUP BY ALL),
b AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(1, octet_length(encode(w)) + 1), lambda j: ('0x' || substr(hex(encode(w)), 2 * j - 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM w), crc),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM w JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (S_ALL + 10000)) / ((s + 1)::DOUBLE * (T_ALL + 10000))))::BIGINT AS gain FROM c, (SELECT sum(s)::DOUBLE AS S_ALL, sum(t)::DOUBLE AS T_ALL FROM c)),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN d ON id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * 10 // 100 THEN r END AS rank FROM x LEFT JOIN r USING (doc_id)
""",
)
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.resampling import importance_resample

    return importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op12_quality_rules",
    r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win) WHERE times > 1), range(3) r(j) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
f AS (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t JOIN w USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS MATERIALIZED (
  SELECT doc_id, lang, base_failed, r.rule, least(r.value, 5000) AS value
  FROM (SELECT *, unnest([
    {'rule': 'symbols', 'value': 1000 * n_symbols // greatest(word_chars, 1)}, {'rule': 'capitals', 'value': 1000 * n_upper // greatest(word_chars, 1)},
    {'rule': 'repeated_lines', 'value': 1000 * n_dup_lines // greatest(n_lines, 1)}, {'rule': 'repeated_words', 'value': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'rule': 'long_words', 'value': 100 * word_chars // greatest(n_words, 1)}]) AS r FROM b)),
crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
lab AS (
  SELECT doc_id, max(quality) AS label, any_value(xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 4 = 0) AS proposes
  FROM labels, crc WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
n AS (
  SELECT lang, rule, value, count(*) FILTER (label = 0 AND proposes) AS bad, count(*) FILTER (label = 1 AND proposes) AS good, count(*) FILTER (label = 1 AND NOT proposes) AS tested
  FROM v JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
s AS (
  SELECT lang, rule, value, bad > 0 AS candidate, sum(bad) OVER d AS bad, sum(good) OVER d AS good, sum(tested) OVER d AS tested, sum(bad) OVER a AS all_bad, sum(good) OVER a AS all_good, sum(tested) OVER a AS all_tested
  FROM n WINDOW d AS (PARTITION BY lang, rule ORDER BY value DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY lang, rule)),
c AS MATERIALIZED (SELECT *, bad / all_bad - 10 * good / greatest(all_good, 1) AS worth FROM s WHERE candidate AND all_tested > 0),
p AS (
  SELECT *, CASE WHEN tested >= all_tested THEN 1 ELSE list_sum(list_transform(range(0, tested::BIGINT + 1), lambda k: exp(lgamma(all_tested + 1) - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END - lgamma(all_tested - k + 1) + k * ln(0.01) + (all_tested - k) * ln(0.99)))) END AS p_value FROM c WHERE worth > 0),
cut AS (SELECT lang, rule, arg_max(value, (round(worth, 9), value)) AS cutoff FROM p WHERE p_value <= 0.05 / (SELECT count(DISTINCT (lang, rule)) FROM c) GROUP BY lang, rule),
broken AS (SELECT doc_id, list(v.rule) AS broken FROM v JOIN cut ON v.rule = cut.rule AND v.lang IS NOT DISTINCT FROM cut.lang AND value >= cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept FROM b LEFT JOIN broken USING (doc_id)
""",
)
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.quality_rules import judged_documents

    judged = judged_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from tomeatlas.llm.cross_tokens import linked_tokens

    linked = linked_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return linked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
