"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, release


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links(a, b)``: rows (node, component), where the
    component is one of its nodes.  Isolated nodes do not appear.

    Each round every node follows the link of the smallest hash that it has, and on from there
    for a few steps; links are then drawn between the ends alone, so those within a group vanish
    at once.  Every node moves, so at least half of the nodes go in each round, and hashes change
    by round: no order of the ids makes long chains.  Only whether any links are left reaches the
    driver.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(links.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        hashed = edges.withColumn("h", F.xxhash64("a", "b", F.lit(turn)))
        both = hashed.union(hashed.select("b", "a", "h"))
        points = both.groupBy(a.alias("node")).agg(F.min_by("b", "h").alias("to"))
        back = points.toDF("to", "back")
        # Two nodes of one link that is the first of both: the smaller one is the end of all that point there.
        end = F.when(F.col("back") == F.col("node"), F.least("node", "to")).otherwise(F.col("to"))
        points = points.join(back, "to").select("node", end.alias("to"))
        for _ in range(2):
            points = points.join(points.toDF("to", "end"), "to").select("node", F.col("end").alias("to"))
        ends = materialise(points.toDF("node", "end"), "ends")
        left, right = ends.toDF("a", "x"), ends.toDF("b", "y")
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        fewer = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        steps.append(ends)
        release(edges)
        edges = fewer
    else:
        raise RuntimeError("components did not settle")
    release(edges)
    if not steps:
        return links.select(a.alias("node"), a.alias("component")).where("false")
    labels = steps[0].toDF("node", "component")
    for ends in steps[1:]:
        labels = labels.join(ends.toDF("component", "end"), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    labels = materialise(labels, "labels")
    for ends in steps:
        release(ends)
    return labels
