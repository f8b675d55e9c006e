"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeatlas.llm.jaccard_join import similar_documents
from tomeatlas.llm.packing import pack
from tomeatlas.llm.quality import quality_scores
from tomeatlas.llm.queries import table, vocabulary
from tomeatlas.llm.radix_dedup import exact_duplicates
from tomeatlas.llm.stored import Stored, few
from tomeatlas.llm.winnowing import contamination

#: Rows that score less are rejected.
LEAST_QUALITY = 0.5

#: SQL cannot say what a fitted classifier and a tokenizer give.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Rows are judged one by one, with or without doc_id; repeated rows alike."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), column="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever their doc_id is; one without doc_id only if all of the group are."""
    return exact_duplicates(docs, carry=docs.columns, nested=True).where("dup_kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that with the smallest doc_id (null last).

    A row's key is its doc_id; if that is null or another row has it too, a hash of doc_id and text. So other texts under the
    same doc_id, or without one, are separate documents; rows that repeat both stay or go together.
    """
    stored = Stored(spark, "near-dedup")
    own = F.col("doc_id").cast("long")
    again = docs.groupBy(own.alias("__again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __again is null").select("__again")
    again = stored.save(again, "repeated")
    keyed = docs.withColumn("__key", own)
    if not again.isEmpty():
        marked = docs.join(few(again), own.eqNullSafe(F.col("__again")) & own.isNotNull(), "left")
        keyed = marked.withColumn("__key", F.when(own.isNull() | F.col("__again").isNotNull(), F.xxhash64(F.lit(1), own, "text")).otherwise(own)).drop("__again")
    groups = similar_documents(keyed.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0")
    groups = stored.save(groups.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("group")).distinct(), "groups")
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members = stored.save(keyed.select("__key", own.alias("id")).join(groups.join(several, "group"), "__key"), "members")
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__key")).alias("first"))
    leaves = stored.save(members.join(stays, "group").where("__key <> first.__key").select("__key").distinct(), "leaves")
    for df in (groups, members):
        stored.drop(df)
    return keyed.join(few(leaves), "__key", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Of rows without doc_id, or that repeat one, only those go whose own text has a passage."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    found = Stored(spark, "decontamination").save(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "found")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(few(found), F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__hash")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    stored = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = stored.save(stage(spark, docs, sf_dir), "stage")
        if id(docs) in stored.paths:
            stored.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
