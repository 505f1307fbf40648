"""Connected components by alternating large and small stars, as joins and partial aggregates.

Edges stay distributed; each round is written to the shared folder, which cuts the lineage and lets a lost
executor's work be read again. Hot nodes only meet in joins, which the adaptive planner splits, and in
aggregates with a map-side part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spark import written


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any order, repeats allowed, nulls ignored. Returns (node, root) for nodes that aren't roots;
    a root is the smallest node of its component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "components")
    while True:
        # Done when the edges are stars: every node has one edge to a smaller one, which has none itself.
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0)) > 1).first()[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
