"""Connected components of an edge table by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_tasks, written


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of `edges(a, b)` with the smallest vertex that it reaches.

    Every round a vertex takes the smallest label among its neighbours and then the label of
    that label, so the rounds grow with the logarithm of a component's diameter. Labels are
    written after each round.
    """
    rows = 2 * edges.count()
    both = written(few_tasks(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), rows), "edges")
    labels = written(few_tasks(both.groupBy("v").agg(F.min("u").alias("u")), rows).select("v", F.least("v", "u").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("near")), "u").groupBy("v").agg(F.min("near").alias("near"))
        hooked = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("jumped"))
        labels = written(few_tasks(hooked.join(jump, "c"), rows).select("v", "old", F.least("c", "jumped").alias("c")), "labels")
        if not labels.where("c <> old").head(1):
            return labels.select("v", "c")
        labels = labels.select("v", "c")


def extended(found: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(v, c): the components of what `found(v, c)` comes from and of the new `edges(a, b)` together.

    New edges are put between the components found before, so those that lie inside one go, and
    edges of earlier rounds are not met again.
    """
    if found is None:
        return components(edges)
    of = lambda name: found.select(F.col("v").alias(name), F.col("c").alias(f"c_{name}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    between = written(between.where("a <> b").distinct(), "between")
    if not between.head(1):
        return found
    upper = written(components(between), "upper")
    moved = found.join(upper.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", F.coalesce("up", "c").alias("c"))
    return written(moved.unionByName(upper.join(found.select("v"), "v", "left_anti")), "components")
