"""Comparison of tables, part lists, metadata, style sets and paragraph sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the alignment tables (of whole documents, of a changed block) over which comparison goes by position and says so.
MAX_ALIGN, MAX_PAIR = 4_000_000, 250_000
CHANGES = "pair_id long, kind string, index_before int, index_after int, style_before string, style_after string, text_before string, text_after string, aligned boolean"


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status (added, removed, changed), before, after: what differs, nulls equal to nulls."""
    x = a.select(*keys, F.col(value).alias("before"), F.lit(1).alias("__a"))
    y = b.select(*keys, F.col(value).alias("after"), F.lit(1).alias("__b"))
    j = x.join(y, keys, "full_outer")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.withColumn("status", status).filter(F.col("status").isNotNull()).select(*keys, "status", "before", "after")


def set_diff(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """value, side: distinct values that only one of both has."""
    one = a.select(value).distinct().join(b.select(F.col(value).alias("__v")), F.col(value) == F.col("__v"), "left_anti").withColumn("side", F.lit("only_a"))
    two = b.select(value).distinct().join(a.select(F.col(value).alias("__v")), F.col(value) == F.col("__v"), "left_anti").withColumn("side", F.lit("only_b"))
    return one.unionByName(two)


def similarity(a: str, b: str) -> float:
    """Dice coefficient of the bigram multisets; equal texts 1, an empty one 0."""
    if a == b:
        return 1.0
    if not a or not b or len(a) + len(b) < 3:
        return 0.0
    from collections import Counter

    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    total = sum(x.values()) + sum(y.values())
    return 2.0 * sum((x & y).values()) / total if total else 0.0


def _suffix_table(gain: np.ndarray, both: bool) -> np.ndarray:
    """best[i, j] of the sequences from i and j on; gain < 0 forbids a pair. Filled by antidiagonals."""
    n, m = gain.shape
    best = np.zeros((n + 1, m + 1))
    for d in range(n + m - 2, -1, -1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        skip = np.maximum(best[i + 1, j], best[i, j + 1])
        take = best[i + 1, j + 1] + gain[i, j]
        best[i, j] = np.where(gain[i, j] < 0, skip, np.maximum(skip, take) if both else take)
    return best


def edit_script(a: list, b: list, limit: int = MAX_ALIGN) -> tuple[list[tuple[str, int, int]], bool]:
    """Operations (equal, remove, add) of a longest common subsequence, removals first; False if by position."""
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > limit:
        k = min(n, m)
        return [("equal", i, i) for i in range(k)] + [("remove", i, -1) for i in range(k, n)] + [("add", -1, j) for j in range(k, m)], False
    front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(n, m))
    if front:  # the walk below would match it all the same
        rest, _ = edit_script(a[front:], b[front:], limit)
        return [("equal", i, i) for i in range(front)] + [(op, i + front if i >= 0 else i, j + front if j >= 0 else j) for op, i, j in rest], True
    ids = {v: i for i, v in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([ids[v] for v in a], int), np.array([ids[v] for v in b], int)
    same = x[:, None] == y[None, :]
    best = _suffix_table(np.where(same, 1.0, -1.0), both=False)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and same[i, j]:
            out.append(("equal", i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1, j] >= best[i, j + 1]):
            out.append(("remove", i, -1))
            i += 1
        else:
            out.append(("add", -1, j))
            j += 1
    return out, True


def pair_block(removed: list[tuple], added: list[tuple]) -> Iterator[tuple[tuple | None, tuple | None]]:
    """Match removed and added (index, style, text) in order, by the largest sum of scores of at least 1.

    A score is twice the text similarity, plus one for the same style. Between matches the unmatched
    of both sides pair by position; what is left over is a plain removal or addition.
    """
    n, m = len(removed), len(added)
    if n * m > MAX_PAIR:
        matches = []
    else:
        score = np.array([[2 * similarity(r[2], s[2]) + ((r[1] or "") == (s[1] or "")) for s in added] for r in removed], float).reshape(n, m)
        gain = np.where(score >= 1, score, -1.0)
        best, matches, i, j = _suffix_table(gain, both=True), [], 0, 0
        while i < n and j < m:
            if gain[i, j] >= 0 and best[i, j] == best[i + 1, j + 1] + gain[i, j]:
                matches.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
    i = j = 0
    for p, q in [*matches, (n, m)]:
        k = min(p - i, q - j)
        yield from zip(removed[i : i + k], added[j : j + k], strict=True)
        yield from ((r, None) for r in removed[i + k : p])
        yield from ((None, s) for s in added[j + k : q])
        if p < n and q < m:
            yield removed[p], added[q]
        i, j = p + 1, q + 1


def compare_sequences(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], bool]:
    """Changes between two paragraph lists of (index, style, text)."""
    ops, aligned = edit_script([(s or "", t) for _, s, t in a], [(s or "", t) for _, s, t in b])
    out, removed, added = [], [], []

    def close() -> None:
        for x, y in pair_block(removed, added):
            if x is None:
                out.append(("add", None, y[0], None, y[1], None, y[2]))
            elif y is None:
                out.append(("remove", x[0], None, x[1], None, x[2], None))
            else:
                kind = "+".join([k for k, differ in (("text", x[2] != y[2]), ("style", x[1] != y[1])) if differ]) or "text"
                out.append((kind, x[0], y[0], x[1], y[1], x[2], y[2]))
        removed.clear()
        added.clear()

    for op, i, j in ops:
        if op == "equal":
            aligned = aligned and len(removed) * len(added) <= MAX_PAIR
            close()
            if not aligned and a[i][1:] != b[j][1:]:
                removed.append(a[i])
                added.append(b[j])
                close()
        elif op == "remove":
            removed.append(a[i])
        else:
            added.append(b[j])
    aligned = aligned and len(removed) * len(added) <= MAX_PAIR
    close()
    return out, aligned


def compare_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes of document pairs; a, b: pair_id, idx, style, text. Equal pairs are dropped before Python; a batch holds many pairs.

    `aligned` is false where the documents or one of their changed blocks were too long to align.
    """
    kinds = {"pair_id": pa.int64(), "kind": pa.string(), "index_before": pa.int32(), "index_after": pa.int32(), "style_before": pa.string(), "style_after": pa.string(), "text_before": pa.string(), "text_after": pa.string(), "aligned": pa.bool_()}

    def lists(column: pa.Array) -> Iterator[list[tuple]]:
        flat = column.flatten()
        rows = list(zip(*(flat.field(c).to_pylist() for c in ("idx", "style", "text")), strict=True)) if len(flat) else []
        at = 0
        for n in column.value_lengths().to_pylist():
            yield rows[at : at + (n or 0)]
            at += n or 0

    def run(it):
        for batch in it:
            out = []
            for pair, x, y in zip(batch.column(0).to_pylist(), lists(batch.column(1)), lists(batch.column(2)), strict=True):
                changes, aligned = compare_sequences(x, y)
                out += [(pair, *c, aligned) for c in changes]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def side(d: DataFrame, k: str) -> DataFrame:
        rows = F.struct(F.col("idx").cast("int").alias("idx"), "style", F.coalesce("text", F.lit("")).alias("text"))
        return d.groupBy(F.col("pair_id").cast("long").alias(f"{k}_id")).agg(F.array_sort(F.collect_list(rows)).alias(k))

    j = side(a, "a").join(side(b, "b"), F.col("a_id").eqNullSafe(F.col("b_id")), "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(F.coalesce("a_id", "b_id").alias("pair_id"), "a", "b").mapInArrow(run, CHANGES)
