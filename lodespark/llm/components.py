"""Connected components of a graph given as links, in joins and aggregations.

Each link is kept as (child, parent) with child > parent. A round points every
child to the smallest parent it knows and links its other parents to that one,
then replaces a parent that is itself a child by its own smallest parent. Both
halve distances, so rounds grow with the logarithm of the longest path. Children
have few parents, so grouping by child is even; the parent side, where the links
of a large component meet, is only ever looked up against a table with one row a
child, through :func:`shared.lookup`, which splits such keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, lookup, materialize


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes that are linked and not their component's smallest node.

    Links may repeat, run both ways or from a node to itself; rows with nulls are
    ignored. No links: no rows."""
    pairs = links.select(F.least(a, b).alias("parent"), F.greatest(a, b).alias("child")).where(f"{a} is not null and {b} is not null and parent < child")
    pairs = materialize(pairs.groupBy("child", "parent").agg(F.lit(1).alias("one")).select("child", "parent"), "links")
    for _ in range(most_rounds):
        least = materialize(pairs.groupBy("child").agg(F.min("parent").alias("root")), "roots")
        # a child's other parents belong with its smallest one
        moved = pairs.join(least, "child").select(F.explode(F.array(F.struct("child", F.col("root").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("root").alias("parent")))).alias("l")).select("l.*").where("child > parent")
        moved = materialize(moved.distinct(), "moved")
        # a parent that has a parent passes its children on
        weighed = moved.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).join(least.withColumnRenamed("child", "parent"), "parent")
        after = lookup(moved, weighed, "parent", "n").select("child", F.coalesce("root", "parent").alias("parent"))
        after = materialize(after.distinct(), "links")
        left = after.join(pairs, ["child", "parent"], "left_anti").isEmpty() and pairs.join(after, ["child", "parent"], "left_anti").isEmpty()
        for old in (least, moved, pairs):
            drop_table(old)
        pairs = after
        if left:
            return pairs.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
