"""Connected components of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_hot


def _star(edges: DataFrame, larger_only: bool, n_edges: int) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on the least of its neighbourhood.

    A hub of a large component holds many edges: they stay where they are and its least goes to them.
    """
    if larger_only:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = join_hot(both, least, ["u"], F.col("n"), 2 * n_edges)
    hung = joined.filter(F.col("v") > F.col("u")) if larger_only else joined
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs -> (node, root): root is the least node of the component.

    Nodes without an edge are absent. Edges stay distributed; only counts reach the driver. Each
    round is a reliable checkpoint; the result is a set of stars, each node on its component's least.
    """

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    current = durable(edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct())
    was = state(current)
    for _ in range(max_rounds):
        nxt = durable(_star(_star(current, True, was[0]), False, was[0]))
        # stars only move downwards: unchanged sums over a set of the same size mean a fixpoint
        now = state(nxt)
        if now == was:
            break
        current, was = nxt, now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
