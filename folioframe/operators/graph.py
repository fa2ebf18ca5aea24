"""Object graphs: reachability over references, and renumbering of what is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import numbered


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import atexit
        import shutil
        import tempfile

        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="folioframe-graph-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return df.checkpoint()


#: Levels after which the seen nodes are dealt anew, and parts after which they are written as one.
DEALT_LEVELS, PARTS = 8, 64


def reachable(edges: DataFrame, roots: DataFrame, max_levels: int = 4000) -> DataFrame:
    """node, depth: all nodes that roots (node) lead to over edges (src, dst); cycles are fine.

    Breadth first. Edges are dealt by src once and held; what was seen is held in the same way, dealt
    anew every DEALT_LEVELS levels. So a level shuffles its own nodes, the ends of their edges and the
    nodes of the few levels before, never all edges. Held tables are counted first: only then the
    planner knows how they are dealt.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer the planner deals held tables anew at every join
    held = []

    def hold(df: DataFrame, key: str) -> tuple[DataFrame, int]:
        held.append(df.sortWithinPartitions(key).persist())
        return held[-1], held[-1].count()

    def drop(df: DataFrame) -> None:
        held.remove(df)
        df.unpersist()

    union = lambda parts: reduce(DataFrame.unionByName, parts).coalesce(n)
    nodes = lambda parts: union(parts).select(F.col("node").alias("s")).repartition(n, "s")
    newest = _checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, fresh, old = [newest], [newest], None
    try:
        out, _ = hold(edges.select("src", "dst").repartition(n, "src"), "src")
        for depth in range(1, max_levels):
            ends = newest.join(out, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
            ends, some = hold(ends.repartition(n, "node").distinct(), "node")
            if not some:
                return union(seen)
            if len(fresh) == DEALT_LEVELS:
                if old is not None:
                    drop(old)
                old, fresh = hold(nodes(seen), "s")[0], []
            new = ends
            for known in ([] if old is None else [old]) + ([nodes(fresh)] if fresh else []):
                new = new.join(known, F.col("node") == F.col("s"), "left_anti")
            newest = _checkpointed(new.withColumn("depth", F.lit(depth)))
            drop(ends)
            if newest.isEmpty():
                return union(seen)
            seen, fresh = [*seen, newest], [*fresh, newest]
            if len(seen) == PARTS:
                seen = [_checkpointed(union(seen))]
    finally:
        for df in held:
            df.unpersist()
    raise RuntimeError("the graph is deeper than max_levels")


def renumber(nodes: DataFrame) -> DataFrame:
    """node, new_id: dense numbers from 1 in node order."""
    return numbered(nodes, "node", "new_id").select("node", "new_id")


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """References (src, dst) under the new ids (node, new_id): src, dst; a reference to what is not kept becomes null."""
    src = ids.select(F.col("node").alias("src"), F.col("new_id").alias("new_src"))
    dst = ids.select(F.col("node").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(src, "src").join(dst, "dst", "left").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def referrers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """node (of `targets`), n, from: how many and which objects refer to it, in order; 0 and an empty list for none."""
    hits = edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("from"))
    joined = targets.select("node").distinct().join(hits, F.col("node") == F.col("dst"), "left")
    got = F.coalesce("from", F.array().cast(hits.schema["from"].dataType))
    return joined.select("node", F.size(got).cast("long").alias("n"), got.alias("from"))


def clean_page_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References (holder, page) without those to pages that are gone; a holder left without any is absent."""
    return refs.join(pages.select("page").distinct(), "page", "left_semi").select("holder", "page")
