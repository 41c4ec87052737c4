"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (a, b): root is the least id of its component.

    Each round every vertex takes the least root among its neighbours, and then its
    root's root, so paths halve; a round is a written table, and the loop ends when none
    changes. Aggregations are partial, and joins on a vertex with many edges can be split.
    """
    both = table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    now = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = now.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        step = table(step, "roots-step")
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = table(step.join(jump, "root").select("id", "was", F.least("root", "next").alias("root")), "roots")
        changed = not after.filter("root <> was").isEmpty()
        forget(step)
        forget(now)
        now = after
        if not changed:
            return now.select("id", "root")
