"""Releases compared by a tree of digests over ranges of the hashed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.plans.release import row_text
from tomeatlas.plans.scratch import materialise

#: Children of a node: one for each hex digit.
FAN = 16
#: Rows that a leaf should hold at most, on average.
LEAF_ROWS = 10_000


def tree_depth(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root with which a leaf of so many rows has ``leaf_rows`` at most, on average."""
    depth = 0
    while FAN**depth * leaf_rows < rows:
        depth += 1
    return depth


def _leaf(key: str, depth: int) -> Column:
    return F.left(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), F.lit(depth))


def _content() -> list[Column]:
    """Number of rows and sums over four parts of their SHA-256 (column ``row_digest``): whatever their order, and added up before the shuffle."""
    parts = [F.conv(F.substr("row_digest", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return [F.count("*").alias("entries"), *[F.sum(p).cast("string").alias(f"sum{i}") for i, p in enumerate(parts)]]


def _with_digest(df: DataFrame) -> DataFrame:
    return df.withColumn("row_digest", F.sha2(row_text(df).cast("binary"), 256))


def digest_tree(df: DataFrame, key: str, depth: int) -> DataFrame:
    """(level, prefix, entries, digest) of all nodes, the root being level 0.

    A row belongs to the leaf named by the first ``depth`` hex digits of its key's SHA-256, so leaves are alike in size and a
    changed row changes one leaf and the nodes above it. A leaf's digest comes from sums, so a key that many rows share is no
    long group; a node's from its at most 16 children in order. Equal rows count as often as they are there. An empty table
    has no node. A null key counts as an empty one; lists, fractions and missing fields are written as in ``row_text``.
    """
    rows = _with_digest(df).select(_leaf(key, depth).alias("prefix"), "row_digest")
    sums = rows.groupBy("prefix").agg(*_content())
    digest = F.sha2(F.concat_ws(":", F.col("entries").cast("string"), *[f"sum{i}" for i in range(4)]).cast("binary"), 256)
    leaves = materialise(sums.select(F.lit(depth).alias("level"), "prefix", "entries", digest.alias("digest")), "digest-leaves")
    tree = nodes = leaves
    child = F.struct("prefix", "digest")
    for level in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(c["prefix"], F.lit(":"), c["digest"]))
        digest = F.sha2(F.array_join(children, ",").cast("binary"), 256)
        nodes = nodes.groupBy(F.left("prefix", F.lit(level)).alias("prefix")).agg(F.sum("entries").alias("entries"), digest.alias("digest"))
        nodes = nodes.select(F.lit(level).alias("level"), "prefix", "entries", "digest")
        tree = tree.unionByName(nodes)
    return tree


def changed_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Prefixes of the leaves that differ between two trees of one depth, or are in one of them only."""
    def leaves(tree: DataFrame, name: str) -> DataFrame:
        depth = tree.agg(F.max("level")).scalar()
        return tree.filter(F.col("level") == depth).select("prefix", F.col("digest").alias(name))

    both = leaves(before, "a").join(leaves(after, "b"), "prefix", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")


def changed_rows(before: DataFrame, after: DataFrame, key: str, leaves: DataFrame, depth: int) -> DataFrame:
    """(key, change, rows_before, rows_after) of the keys whose rows are not the same in both: added, removed or changed.

    Only rows of the given leaves are digested and compared; the others are left out by their key, before the shuffle if the
    leaves are few. A key with several rows is compared as a whole.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        near = df.withColumn("prefix", _leaf(key, depth)).join(leaves, "prefix", "left_semi").drop("prefix")
        keyed = _with_digest(near).groupBy(key).agg(*_content())
        return keyed.select(F.col(key).alias(f"key_{name}"), F.col("entries").alias(f"rows_{name}"), F.struct(*[f"sum{i}" for i in range(4)]).alias(f"sums_{name}"))

    both = side(before, "before").join(side(after, "after"), F.col("key_before").eqNullSafe(F.col("key_after")), "full")
    change = F.when(F.col("rows_before").isNull(), "added").when(F.col("rows_after").isNull(), "removed").otherwise("changed")
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("sums_before").eqNullSafe(F.col("sums_after"))
    return both.filter(~same).select(F.coalesce("key_before", "key_after").alias(key), change.alias("change"), F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))
