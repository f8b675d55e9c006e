"""Exact duplicates by recursive partitioning on successive bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import Stored, by_number

#: Characters that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"
FIRST_SLICE, GROWTH = 32, 8


def without_blanks(text: Column) -> Column:
    """A text without ASCII blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


#: A column of the carried row may have one of these names: take ``nested`` rows then.
RESULT = ("dup_keep_id", "dup_size", "dup_kept", "dup_sha256")


def exact_duplicates(docs: DataFrame, carry: Sequence[str] = ("doc_id",), first_slice: int = FIRST_SLICE, growth: int = GROWTH, nested: bool = False) -> DataFrame:
    """Group texts that are equal but for ASCII blanks, and name the row of each group that stays.

    The documents are split by the next slice of their bytes, again and again: those alone in their part, or whose
    text has ended together, are done; the others go on with the rest of their text. Slices grow by ``growth``, so a
    text of n bytes takes about log(n) rounds. A round moves row numbers and slices only; the rest of a text is fetched by
    row number, and only if the slice agrees with that of another row. Bytes are compared as they are, without a
    digest. A part is counted by partial sums and joined back to its slices, so a part with a large share of all rows is
    spread by Spark's handling of skewed joins; rows alone in their part are in no later join on the part.

    Of equal texts the one with most code points stays, of those the smallest doc_id (null last), of rows that repeat
    both just one. Null counts as empty, and all empty texts are equal. An empty table gives no rows.

    Returns the columns ``carry`` of every input row (as one struct column ``row`` if ``nested``), and dup_keep_id, dup_size,
    dup_kept, dup_sha256 (of the compared text, in hex). Further columns are not read, and other names cannot clash with
    them; to carry a column of one of these four names, ask for nested rows.
    """
    if not nested and (clash := set(RESULT) & set(carry)):
        raise ValueError(f"{sorted(clash)} would be there twice; take nested rows")
    spark = docs.sparkSession
    stored = Stored(spark, "radix")
    base = stored.save(docs.select(F.struct(*[F.col(c) for c in dict.fromkeys([*carry, "doc_id", "text"])]).alias("row"), F.monotonically_increasing_id().alias("nth")), "rows")
    text = F.col("row.text")
    compared = without_blanks(text).cast("binary")
    todo, size, done, held = base.select("nth", F.lit(0).cast("long").alias("part"), compared.alias("rest")), first_slice, [], []
    while True:
        cut = todo.select("nth", "part", F.substring("rest", 1, size).alias("slice"))
        parts = cut.groupBy("part", "slice").agg(F.min("nth").alias("next"), F.count(F.lit(1)).alias("members")).where("members > 1")
        parts = stored.save(parts, "parts")  # a join of two shuffles, which Spark can split where a part is large
        agree = cut.join(parts, ["part", "slice"]).select("nth", F.col("next").alias("part"), (F.octet_length("slice") < size).alias("ended"))
        agree = stored.save(agree, "agree")
        stored.drop(parts)
        done.append(agree)
        going = agree.where("not ended").select("nth", F.col("part").alias("next"))
        if going.isEmpty():
            break
        rest = by_number(todo.select("nth", F.expr(f"substring(rest, {size + 1})").alias("rest")), going, "inner").select("nth", F.col("next").alias("part"), "rest")
        rest = stored.save(rest, "rest")
        for df in held:
            stored.drop(df)
        todo, held, size = rest, [rest], size * growth
    together = done[0].where("ended")
    for df in done[1:]:
        together = together.unionByName(df.where("ended"))
    together = stored.save(together.select("nth", "part"), "together")
    facts = base.select("nth", F.col("row.doc_id").alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("chars"))
    facts = stored.save(by_number(facts, together, "inner"), "facts")
    first = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "nth"))
    groups = facts.groupBy("part").agg(first.alias("first"), F.count(F.lit(1)).alias("members"))
    grouped = facts.join(groups, "part").select("nth", F.col("first.id").alias("keep"), (F.col("first.nth") == F.col("nth")).alias("kept"), "members")
    grouped = stored.save(grouped, "grouped")
    for df in [*held, *done, together, facts]:
        stored.drop(df)
    found = by_number(base, grouped, "left").select(
        F.struct(*[F.col("row")[c].alias(c) for c in carry]).alias("row"),
        F.when(F.col("members").isNull(), F.col("row.doc_id")).otherwise(F.col("keep")).cast("long").alias("dup_keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("dup_size"),
        F.coalesce("kept", F.lit(True)).alias("dup_kept"),
        F.sha2(compared, 256).alias("dup_sha256"),
    )
    return found if nested else found.select("row.*", *RESULT)
