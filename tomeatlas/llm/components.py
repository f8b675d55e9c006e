"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeatlas.llm.stored import Stored


def components(edges: DataFrame, stored: Stored) -> DataFrame:
    """Columns node, to of every node of ``edges`` (a, b): nodes of one component, and only they, share ``to``.

    In each round every node goes to the smallest of itself and its neighbours, and the edges move to these, until none
    are left. Nodes with many neighbours are met by partial minima and skew-handling joins only.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored.save(both, "edges")
    whole = None
    while True:
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
        step = stored.save(step, "steps")
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = both.join(left, "a").join(right, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct()
        moved = stored.save(moved, "edges")
        if whole is None:
            new = step
        else:
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            new = stored.save(whole.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "whole")
            stored.drop(whole)
            stored.drop(step)
        stored.drop(both)
        whole, both = new, moved
        if both.isEmpty():
            stored.drop(both)
            return whole
