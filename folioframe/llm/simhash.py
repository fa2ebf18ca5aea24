"""SimHash near-duplicates: fingerprints, linked by vantage-point trees.

A vantage-point tree over fingerprints is fitted on a bounded sample; its leaves are shards. At a
node with vantage v and radius m a fingerprint x goes to the inner side if d(x, v) <= m + t and to
the outer side if d(x, v) > m, t being the link distance: by the triangle inequality two linked
fingerprints on different sides differ by at most t in their distance to v, so the outer one of
them is also copied to the inner side, and every linked pair meets in a shard. Inside a shard the
same tree goes on, as deep as it pays, and the points of a leaf are compared exactly. A shard gives
a spanning forest of its links, not all pairs; components join the forests.

Defined results: a null text is the empty text; a text without words has fingerprint zero, linked
like any other; equal fingerprints are one node with the least id; a null id takes part, and a
group of null ids only has a null component; an empty table gives an empty table; only id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, durable, hex64, join_hot, keyed, relieve_driver
from .components import components
from .exact_dedup import holds, repeated_bitmap

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints the tree is fitted on: one in SHARE, within these bounds; shard size aimed at, points that are compared without a tree.
SAMPLE, SAMPLE_MOST, SHARE, SHARD, LEAF = 1 << 15, 1 << 20, 1 << 10, 1 << 16, 1 << 10


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    w = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at 0x20 and 0x09-0x0D
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        h = [digest(b" ".join(w), seed)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w])
        joined, starts = b" ".join(w), [0, *ends[: -words].tolist()]
        h = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.array(h[i : i + (1 << 16)], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp: the 64 bits of every row's fingerprint as a long."""

    def run(it):
        for b in batches_by_bytes(it, "text", 4 << 20):
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _cut(points: np.ndarray, distance: int, tries: int = 12) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage, radius, distances) of the cut with the fewest points on its fuller side; None if no cut shrinks."""
    best = None
    step = max(1, len(points) // tries)
    probe = points[:: max(1, len(points) // 2048)]
    for v in points[::step][:tries]:
        counts = np.bincount(_distances(probe, v), minlength=65).cumsum()
        inner = counts[np.minimum(np.arange(65) + distance, 64)]  # radius m: inner d <= m + distance, outer d > m
        fuller = np.maximum(inner, counts[-1] - counts)
        m = int(fuller.argmin())
        if best is None or fuller[m] < best[0]:
            best = (int(fuller[m]), v, m)
    _, v, m = best
    d = _distances(points, v)
    return (v, m, d) if (d > m + distance).any() and (d <= m).any() else None


def build_tree(points: np.ndarray, leaf: int, distance: int = DISTANCE) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer); a child below 0 is the leaf -child - 1. No node: one leaf."""
    nodes: list = []
    leaves = 0

    def grow(p: np.ndarray) -> int:
        nonlocal leaves
        got = _cut(p, distance) if len(p) > leaf else None
        if got is None or max((got[2] <= got[1] + distance).sum(), (got[2] > got[1]).sum()) > 0.9 * len(p):
            leaves += 1
            return -leaves
        v, m, d = got
        at = len(nodes)
        nodes.append(None)
        inner = grow(p[d <= m + distance])
        nodes[at] = (int(v), m, inner, grow(p[d > m]))
        return at

    grow(np.unique(points))
    return nodes


def shards_of(points: np.ndarray, nodes: list, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, leaf) of every shard that a point belongs to or is copied to."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    at, leaf = [], []

    def walk(node: int, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if node < 0:
            at.append(idx)
            leaf.append(np.full(len(idx), -node - 1, np.int64))
            return
        v, m, inner, outer = nodes[node]
        d = _distances(points[idx], np.uint64(v))
        walk(inner, idx[d <= m + distance])
        walk(outer, idx[d > m])

    walk(0, np.arange(len(points)))
    return (np.concatenate(at), np.concatenate(leaf)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Forest:
    """Union-find over positions; roots are least positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs, all at once, until nothing changes."""
        up = self.up
        while True:
            ra, rb = up[a], up[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            differ = lo != hi
            if not differ.any():
                return
            np.minimum.at(up, hi[differ], lo[differ])
            while True:
                nxt = up[up]
                if (nxt == up).all():
                    break
                up[:] = nxt


def spanning_links(points: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> np.ndarray:
    """For each of the distinct, sorted points the position of the least point that it is linked with, over any path."""
    forest = _Forest(len(points))

    def compare(idx: np.ndarray) -> None:
        p, rest = points[idx], np.arange(len(idx))
        if len(idx) > leaf:
            # a dense ball: neighbours at one bit join first; what is not in the largest part then meets all points
            for bit in range(64):
                other = p ^ np.uint64(1 << bit)
                at = np.minimum(np.searchsorted(p, other), len(p) - 1)
                hit = np.flatnonzero(p[at] == other)
                forest.link(idx[hit], idx[at[hit]])
            roots = forest.up[idx]
            values, counts = np.unique(roots, return_counts=True)
            rest = np.flatnonzero(roots != values[counts.argmax()])
        # blocks of rows against the others, so that memory stays bounded
        step = max(1, (1 << 22) // max(1, len(p)))
        for i in range(0, len(rest), step):
            mine = rest[i : i + step]
            first = 0 if len(idx) > leaf else i  # without a largest part, later points only
            a, b = np.nonzero(np.bitwise_count(p[mine, None] ^ p[None, first:]) <= distance)
            forest.link(idx[mine[a]], idx[b + first])

    def walk(idx: np.ndarray) -> None:
        got = _cut(points[idx], distance, 6) if len(idx) > leaf else None
        if got is None:
            return compare(idx)
        _, m, d = got
        inner, outer = d <= m + distance, d > m
        if max(inner.sum(), outer.sum()) > 0.9 * len(idx):
            return compare(idx)
        walk(idx[inner])
        walk(idx[outer])

    walk(np.arange(len(points)))
    return forest.up


def linked_fingerprints(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """fp (distinct) -> (u, v): links that join the same fingerprints as all pairs within the distance do."""
    size = min(SAMPLE_MOST, max(SAMPLE, n // SHARE))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = build_tree(sample, max(16, int(SHARD * len(sample) / max(1, n))), distance)

    def route(it):
        for b in it:
            p = b.column(0).to_numpy().view(np.uint64)
            at, leaf = shards_of(p, nodes, distance)
            yield pa.record_batch([pa.array(leaf), pa.array(p[at].view(np.int64))], ["shard", "fp"])

    def link(t: pa.Table) -> pa.Table:
        # points as unsigned, but roots as the signed order that components() compares
        signed = np.unique(t.column("fp").to_numpy())
        up = spanning_links(signed.view(np.uint64), distance)
        linked = up != np.arange(len(up))
        return pa.table({"u": pa.array(signed[linked], pa.int64()), "v": pa.array(signed[up[linked]], pa.int64())})

    return distinct.select("fp").mapInArrow(route, "shard long, fp long").groupBy("shard").applyInArrow(link, "u long, v long")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """fp, root, component_id, n (rows of the fingerprint), n_rows (of the component) for every fingerprint of `prints` (doc_id, fp)."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    n_distinct = distinct.count()
    roots = components(linked_fingerprints(distinct, n_distinct, distance))
    rooted = durable(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_fps"))
    joined = join_hot(rooted.select("fp", "root", "n"), ids, ["root"], F.col("n_fps"), n_distinct)
    return joined.select("fp", "root", "component_id", "n", "n_rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the least id that is reachable over links, for every row."""
    prints = durable(fingerprints(docs, id_col, text_col, words))
    classes = _classes(prints, distance).select("fp", "component_id", "n")
    return join_hot(prints, classes, ["fp"], F.col("n"), prints.count()).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component: that of the least id.

    Among rows with that id the least row, compared column by column, stays. What is dropped is
    decided on ids, text hashes and fingerprints alone. Rows that a bitmap of the keys in question
    does not hold pass straight through; the others meet these keys, and rows that share the least
    id of a component meet in partial minima.
    """
    names = docs.columns
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # a null id is above the others here: a row with an id stays if there is one
    rank = F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1))
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), rank.alias("k"), F.xxhash64(text).alias("th"))

    def run(it):
        for b in batches_by_bytes(it, "text", 4 << 20):
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    prints = durable(docs.select(rank.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long"))
    n_rows = prints.count()
    relieve_driver(docs.sparkSession)
    classes = _classes(prints.select("doc_id", "fp"), distance).filter("n_rows > 1")
    members = join_hot(prints, classes, ["fp"], F.col("n"), n_rows).select(F.col("doc_id").alias("k"), "th", "root", "component_id")
    relieve_driver(docs.sparkSession)
    # rows of the least id stay, and the least of them if there are several
    keys = members.groupBy("k", "th").agg(F.min("root").alias("root"), F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    keys = durable(keys.withColumn("stays", F.col("k") == F.col("component_id")))
    stays = keys.filter("stays")  # of any component, however large, those of one id
    several = stays.groupBy("root").agg(F.sum("n").alias("s")).filter("s > 1")
    asked = durable(keys.filter("NOT stays").unionByName(stays.join(several, "root", "left_semi").select(*keys.columns)).select("k", "th", "root", "stays", "n"))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(asked.select(F.xxhash64("k", "th").alias("fp")), asked.count()))

    @F.pandas_udf("boolean")
    def perhaps(key: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, key.to_numpy(np.int64).view(np.uint64)))

    marked = packed.withColumn("ask", perhaps(F.xxhash64("k", "th")))
    clear = marked.filter(~F.col("ask")).select("row")
    # a row may ask by chance, so the keys in question are joined to all that ask
    hot = F.col("n") * 4096 > n_rows  # fewer than 4096 keys
    near = marked.filter("ask").join(F.broadcast(asked.filter(hot).select("k", "th", F.col("root").alias("r1"), F.col("stays").alias("s1"))), ["k", "th"], "left")
    far = near.filter("r1 IS NULL").drop("r1", "s1").join(asked.filter(~hot).select("k", "th", F.col("root").alias("r1"), F.col("stays").alias("s1")), ["k", "th"], "left")
    met = near.filter("r1 IS NOT NULL").unionByName(far)
    by_chance = met.filter("r1 IS NULL").select("row")
    kept = met.filter("s1").groupBy("r1").agg(F.min("row").alias("row")).select("row")
    return clear.unionByName(by_chance).unionByName(kept).select("row.*")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
