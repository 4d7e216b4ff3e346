"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import Scratch


def components(edges: DataFrame, into: Scratch) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b): comp is the smallest id of its component. The result is a table of ``into``.

    Each round hooks every node to its smallest neighbour, follows the hooks twice
    and contracts the edges, so the rounds grow with the logarithm of the longest
    path. Tables go to the shared folder after each round; nothing is collected.
    """
    left = into.stage(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    found = into.stage(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("comp")), "cc-found")
    while left.take(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("v", F.col("pp").alias("p"))
        hook = into.stage(hook, "cc-hook")
        ends = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        again = left.join(ends[0], "a").join(ends[1], "b").where("pa <> pb")
        again = into.stage(again.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        moved = found.join(hook.select(F.col("v").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp"))
        moved = into.stage(moved, "cc-found")
        for old in (left, found, hook):
            into.drop(old)
        left, found = again, moved
    into.drop(left)
    return found
