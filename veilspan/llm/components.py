"""Connected components of an edge table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, root) of every node of edges (a, b), both long; root is the smallest id of
    the component. Null ends and loops are ignored.

    Each round every node moves to its neighbour (or itself) of least hash, and the
    edges between what is left go on. As hashes are random, a round removes a constant
    share of the nodes whatever the shape, stars and chains too; a node's neighbours
    are only ever aggregated, never gathered. Rounds end the lineage in the shared
    folder.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), tag)
    at = materialize(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("now")), tag)
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        moved = materialize(least.select("a", F.least("m", order("a"))["v"].alias("to")), tag)
        ends = left.join(moved.withColumnRenamed("to", "ta"), "a").join(moved.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        left = materialize(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), tag)
        at = materialize(at.join(moved.withColumnRenamed("a", "now"), "now", "left").select("id", F.coalesce("to", "now").alias("now")), tag)
    root = at.groupBy("now").agg(F.min("id").alias("root"))
    return at.join(root, "now").select("id", "root")
