"""Positional text: tables from positioned runs, wrapping and pagination."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Characters as wide as they are high.
WIDE = r"[⺀-鿿豈-﫿＀-￯]"
_WIDE, _WORDS = re.compile(WIDE), re.compile(r"\s+|\S+")
TABLES = "doc_id long, page int, tbl int, r int, cells array<string>, y_top double, y_bottom double, row_tolerance double"


def text_width(text: str, size: float | None) -> float:
    wide = 0 if text.isascii() else len(_WIDE.findall(text))
    return (0.5 * len(text) + 0.5 * wide) * (size if size and np.isfinite(size) and size > 0 else 10)


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted values: the larger middle one where n is even."""
    return F.get(F.sort_array(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


def row_gaps(runs: DataFrame) -> DataFrame:
    """doc_id, page, median_gap, tolerance: distances of text lines, by windows over distinct heights."""
    ys = runs.filter(F.trim("text") != "").select("doc_id", "page", F.round("y", 2).alias("y")).distinct()
    gaps = ys.withColumn("gap", F.lag("y").over(W.partitionBy("doc_id", "page").orderBy(F.col("y").desc())) - F.col("y"))
    m = gaps.groupBy("doc_id", "page").agg(F.coalesce(upper_median(F.when(F.col("gap") > 0.5, F.col("gap"))), F.lit(12.0)).alias("median_gap"))
    return m.withColumn("tolerance", F.greatest(F.lit(2.0), F.least(F.col("median_gap") * 0.45, F.lit(12.0))))


def _split_wide_gaps(run: tuple) -> list[tuple]:
    """A run (x, text, size) cut at two or more blanks, the parts placed by estimated widths."""
    x, text, size = run
    if "  " not in text:
        return [run]
    out, at = [], 0
    for gap in re.finditer(r" {2,}|\Z", text):
        if gap.start() > at:
            out.append((round(x + text_width(text[:at], size), 2), text[at : gap.start()], size))
        at = gap.end()
    return out


def _nearest(starts: list[float], x: float) -> int:
    return min(range(len(starts)), key=lambda i: (abs(starts[i] - x), i))


def _join(left: str, right: str) -> str:
    if not left or not right:
        return left or right
    return left + ("" if re.match(WIDE, left[-1]) or re.match(WIDE, right[0]) else " ") + right


class _Block:
    """Consecutive lines of one table, with the column starts met so far."""

    def __init__(self, gap: float):
        self.gap, self.lines, self.starts = gap, [], []

    def fits(self, runs: list[tuple]) -> bool:
        return bool(self.lines and runs) and all(any(abs(s - x) <= min(self.gap, 2) for s in self.starts) for x, _, _ in runs)

    def add(self, y: float, runs: list[tuple]) -> None:
        self.lines.append((y, runs))
        for x, _, _ in runs:
            if all(abs(s - x) > self.gap for s in self.starts):
                self.starts.append(x)

    def table(self, min_rows: int, min_cols: int) -> tuple[list[list[str]], float, float] | None:
        starts = sorted(self.starts)
        if len(self.lines) < min_rows or len(starts) < min_cols:
            return None
        grid = []
        for _, runs in self.lines:
            row = [""] * len(starts)
            for x, text, _ in runs:
                k = _nearest(starts, x)
                row[k] = _join(row[k], text)
            grid.append(row)
        used = [k for k in range(len(starts)) if any(r[k].strip() for r in grid)]
        rows = [[r[k] for k in used] for r in grid if any(c.strip() for c in r)]
        if len(used) < min_cols or len(rows) < min_rows:
            return None
        return rows, round(self.lines[0][0], 2), round(self.lines[-1][0], 2)


def page_tables(runs: list[tuple], row_tolerance: float | None = None, column_gap: float = 8, min_rows: int = 2, min_cols: int = 2) -> tuple[list, float]:
    """Tables of a page from runs (x, y, text, size): lines by height, columns by starts.

    A line is anchored at its first run's height. It belongs to a table if it has a wide gap or if
    all its runs start where the table's columns do; other lines end the table.
    """
    runs = [r for r in runs if r[2].strip()]
    heights = sorted({round(r[1], 2) for r in runs}, reverse=True)
    gaps = sorted(a - b for a, b in zip(heights, heights[1:], strict=False) if a - b > 0.5)
    tolerance = row_tolerance if row_tolerance is not None else max(2.0, min((gaps[len(gaps) // 2] if gaps else 12.0) * 0.45, 12.0))
    lines: list[tuple[float, list]] = []
    for x, y, text, size in sorted(runs, key=lambda r: (-r[1], r[0])):
        if not lines or abs(lines[-1][0] - y) > tolerance:
            lines.append((y, []))
        lines[-1][1].append((x, text, size))
    found, block = [], _Block(column_gap)
    for y, parts in [*lines, (0.0, [])]:
        parts = [p for run in sorted(parts, key=lambda r: r[0]) for p in _split_wide_gaps(run)]
        wide = max([column_gap, *[1.2 * (s or 0) for _, _, s in parts]])
        split = any(b[0] - (a[0] + text_width(a[1], a[2])) > wide for a, b in zip(parts, parts[1:], strict=False))
        if parts and (split or block.fits(parts)):
            block.add(y, parts)
            continue
        if got := block.table(min_rows, min_cols):
            found.append(got)
        block = _Block(column_gap)
    return found, round(tolerance, 2)


def extract_tables(runs: DataFrame, **options) -> DataFrame:
    """Tables of pages from positioned runs (doc_id, page, text, x, y, font_size).

    Pages are sorted inside partitions and taken from Arrow batches as they come; a task holds one
    batch and the page that it ends in.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("tbl", pa.int32()), ("r", pa.int32()), ("cells", pa.list_(pa.string())), ("y_top", pa.float64()), ("y_bottom", pa.float64()), ("row_tolerance", pa.float64())])

    def run(it):
        key, held, rows = None, [], []

        def close() -> None:
            if held:
                found, tolerance = page_tables(held, **options)
                rows.extend((*key, t, i, r, top, bottom, tolerance) for t, (grid, top, bottom) in enumerate(found) for i, r in enumerate(grid))
                held.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows.clear()
            return out

        for b in it:
            for doc, page, *one in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page", "x", "y", "text", "font_size")), strict=True):
                if (doc, page) != key:
                    close()
                    key = doc, page
                if one[2] is not None:
                    held.append(one)
            if rows:
                yield batch()
        close()
        if rows:
            yield batch()

    own = runs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "font_size")])
    return own.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(run, TABLES)


def wrap(line: str, width: float, size: float = 10) -> list[str]:
    """Greedy wrapping at blanks; a word wider than the line is cut. Widths are prefix sums of half sizes."""
    if len(line) * size <= width:  # even if all are wide
        return [line]
    at = np.zeros(len(line) + 1, np.int64)
    at[1:] = 1
    for m in _WIDE.finditer(line):
        at[m.start() + 1] = 2
    at = np.cumsum(at).tolist()
    most = int(width / (0.5 * size)) + 1  # half sizes that fit
    while most > 0 and 0.5 * most * size > width:
        most -= 1
    if at[-1] <= most:
        return [line]
    out, start, end = [], 0, 0  # the current line is line[start:end]
    for word in _WORDS.finditer(line):
        if end > start and at[word.end()] - at[start] > most:
            out.append(line[start:end].rstrip())
            start = word.end() if word[0].isspace() else word.start()
        end = word.end()
        while end - start > 1 and at[end] - at[start] > most:
            cut = min(bisect_right(at, at[start] + most) - 1, end - 1)
            cut = cut if cut - start > 1 else start + 1
            out.append(line[start:cut])
            start = cut
    if end > start:
        out.append(line[start:end].rstrip())
    return out or [""]


def paginate(documents: DataFrame, width: float, lines_per_page: int, size: float = 10) -> DataFrame:
    """doc_id, page, line, text: wrapped lines on pages; a form feed starts a new page."""
    kinds = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string())])

    def run(it):
        for b in it:
            docs, pages, places, texts = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = 0
                for part in (text or "").split("\f"):
                    lines = [w for line in part.split("\n") for w in wrap(line, width, size)]
                    n = len(lines)
                    docs += [doc] * n
                    pages += [page + i // lines_per_page for i in range(n)]
                    places += [i % lines_per_page for i in range(n)]
                    texts += lines
                    page += max(1, -(-n // lines_per_page))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip((docs, pages, places, texts), kinds, strict=True)], schema=kinds)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, page int, line int, text string")
