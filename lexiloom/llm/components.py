"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, skew_join


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, m, n, off): the least of u and its neighbours v, how many these are, and whether u is no root or leaf of a star; partial results are taken before the shuffle."""
    below = F.col("v") < F.col("u")
    found = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.count_if(below).alias("below"))
    return found.select("u", F.least("u", "m").alias("m"), "n", ((F.col("below") > 0) & (F.col("n") > 1)).alias("off"))


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the component's least node.

    Alternating large-star and small-star steps: each step replaces a node's edges by edges to
    the least neighbour, so the edges never become more, and a component ends as a star around
    its least node; that is seen from the neighbours of each node, before a round. The edges of a
    hub are split among tasks. Each step's tables are written to the shared folder, so that no plan
    computes one twice, as large plans cost the driver memory. Self-loops and repeated edges are
    allowed; null ends are dropped; no edges give no rows; edges that don't settle in limit rounds
    are an error.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct()
    for _ in range(limit):
        e = durable(e, "edges")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = durable(_nearest(both), "nearest")
        if nearest.where("off").isEmpty():
            break
        n = e.count()
        large = skew_join(both.where("v > u"), nearest.select("u", "m", "n"), "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = durable(large, "down")  # the greater end stays first, as m <= u < v
        nearest = durable(_nearest(down).select("u", "m", "n"), "nearest")
        small = skew_join(down, nearest, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(nearest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_classes(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with the root and component_id of their node; nodes: (fp, least id, n rows); roots: (node, root).

    Neither a node of many rows nor a class of many nodes meets in one task.
    """
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = durable(named, "roots")
    least = durable(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    found = skew_join(named.select("fp", "root", F.col("n").alias("copies")), least, "root", named.count())
    found = durable(found.select("fp", "root", "component_id", F.col("copies").alias("n")), "classes")
    return skew_join(rows.select("doc_id", "fp"), found, "fp", rows.count()).select("doc_id", "fp", "root", "component_id")
