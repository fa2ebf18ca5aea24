"""Edits of ordered things: paragraphs, slides, pages, table rows. Order is a dense 0-based index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.exprs import number_text, rotation


def insert_after(items: DataFrame, keys: list[str], index: str, after: int, values: dict[str, Column]) -> DataFrame:
    """A new item behind index `after` of every group (-1: at the front); later ones move down."""
    moved = items.withColumn(index, F.when(F.col(index) > after, F.col(index) + 1).otherwise(F.col(index)).cast("long"))
    heads = items.groupBy(*keys).agg(F.max(index).alias("__last")).filter(F.col("__last") >= after)
    new = heads.select(*keys, F.lit(after + 1).cast("long").alias(index), *[v.alias(k) for k, v in values.items()])
    return moved.unionByName(new.select(*moved.columns))


def delete_at(items: DataFrame, keys: list[str], index: str, at: int) -> DataFrame:
    """Without item `at` of every group; a group's only item stays, as a document needs one."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    kept = items.withColumn("__n", n).filter((F.col(index) != at) | (F.col("__n") == 1))
    return kept.withColumn(index, F.when((F.col(index) > at) & (F.col("__n") > 1), F.col(index) - 1).otherwise(F.col(index)).cast("long")).drop("__n")


def update_at(items: DataFrame, index: str, at: int, column: str, value: Column, protected: Column | None = None) -> DataFrame:
    """Set a column of item `at`, unless `protected` says that it holds markup that would be lost."""
    hit = F.col(index) == at
    return items.withColumn(column, F.when(hit if protected is None else hit & ~protected, value).otherwise(F.col(column)))


def move(items: DataFrame, index: str, frm: int, to: int) -> DataFrame:
    """Item `frm` goes to place `to`; those between close up."""
    i = F.col(index)
    shifted = F.when(i == frm, to).when((i > frm) & (i <= to), i - 1).when((i < frm) & (i >= to), i + 1).otherwise(i)
    return items.withColumn(index, shifted.cast("long"))


def reorder(items: DataFrame, index: str, order: list[int]) -> DataFrame:
    """A full permutation: place k takes the item that stood at order[k]."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("the order must name every index once")
    places = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return items.withColumn(index, F.element_at(places, F.col(index).cast("int")).cast("long"))


def pick(items: DataFrame, index: str, pages: list[int]) -> DataFrame:
    """The listed items in the listed order; a repeated index counts once, at its last place."""
    places = {p: k for k, p in enumerate(pages)}
    dense = {p: k for k, p in enumerate(sorted(places, key=places.get))}
    chosen = F.create_map(*[x for p, k in dense.items() for x in (F.lit(p), F.lit(k))])
    return items.filter(F.col(index).isin(*dense)).withColumn(index, F.element_at(chosen, F.col(index).cast("int")).cast("long"))


def duplicate(items: DataFrame, index: str, at: int, dropped: list[str]) -> DataFrame:
    """A copy of item `at` behind it; columns in `dropped` (such as notes) are null in the copy."""
    moved = items.withColumn(index, F.when(F.col(index) > at, F.col(index) + 1).otherwise(F.col(index)).cast("long"))
    copy = items.filter(F.col(index) == at).withColumn(index, F.lit(at + 1).cast("long"))
    kinds = dict(items.dtypes)
    return moved.unionByName(copy.withColumns({c: F.lit(None).cast(kinds[c]) for c in dropped}))


def concatenate(items: DataFrame, doc: str, group: Column, index: str) -> DataFrame:
    """Documents of a group become one, in order of `doc`, with running indices `merged_index`."""
    counts = items.groupBy(group.alias("__g"), F.col(doc).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__g").orderBy("__d").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__d", F.col("__g").alias("merged_doc"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    joined = items.join(offsets, F.col(doc) == F.col("__d"))
    return joined.withColumn("merged_index", (F.col("__o") + F.col(index)).cast("long")).drop("__d", "__o")


def rotate(items: DataFrame, degrees: Column, current: Column | None = None) -> DataFrame:
    """rotation: set, or added to the current one, to quarter turns."""
    return items.withColumn("rotation", rotation(degrees if current is None else degrees + current))


def label(items: DataFrame, keys: list[str], index: str, template: str, start_at: int = 1, pages: list[int] | None = None) -> DataFrame:
    """Page labels from a template with {page}, {total} (all pages) and {n} (labelled pages)."""
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    chosen = items.withColumn("__t", total)
    if pages is not None:
        chosen = chosen.filter(F.col(index).isin(*pages))
    order = F.row_number().over(W.partitionBy(*keys).orderBy(index))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    text = F.replace(F.lit(template), F.lit("{page}"), (order + (start_at - 1)).cast("string"))
    text = F.replace(F.replace(text, F.lit("{total}"), F.col("__t").cast("string")), F.lit("{n}"), n.cast("string"))
    return chosen.withColumn("label", text).drop("__t")


def _beside_width(rows: DataFrame) -> DataFrame:
    """Rows (r, cells array) with `w`, the cells of the widest."""
    return rows.join(F.broadcast(rows.agg(F.max(F.size("cells")).alias("w"))))  # one row


def pad_table(rows: DataFrame) -> DataFrame:
    """(r, cells array) of a ragged table -> all rows as wide as the widest, blanks empty."""
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    return _beside_width(rows).select("r", F.concat(cells, F.array_repeat(F.lit(""), F.col("w") - F.size(cells))).alias("cells"))


def pad_lines(rows: DataFrame, separator: str) -> DataFrame:
    """r, line: the rows of `pad_table` joined. The blanks behind a row's own cells are written as one run of separators, never as cells."""
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    blanks = F.repeat(F.lit(separator), F.col("w") - F.greatest(F.size(cells), F.lit(1)))
    return _beside_width(rows).select("r", F.concat(F.array_join(cells, separator, ""), blanks).alias("line"))


def merge_cells(cells: DataFrame, keys: list[str], r0: int, c0: int, rows: int, cols: int) -> DataFrame:
    """Table cells (r, c, text) after merging a rectangle: texts that are not empty join its first cell."""
    inside = F.col("r").between(r0, r0 + rows - 1) & F.col("c").between(c0, c0 + cols - 1)
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("r", "c", "text"))))
    merged = cells.filter(inside).groupBy(*keys).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    merged = merged.select(*keys, F.lit(r0).cast("long").alias("r"), F.lit(c0).cast("long").alias("c"), "text")
    return cells.filter(~inside).select(*keys, F.col("r").cast("long"), F.col("c").cast("long"), "text").unionByName(merged)


def insert_row(cells: DataFrame, keys: list[str], after: int) -> DataFrame:
    """An empty row as wide as its table behind row `after` (-1: in front) of every table cell list (keys, r, c, text) that has it."""
    kinds = dict(cells.dtypes)
    shape = cells.groupBy(*keys).agg(F.max("c").alias("__w"), F.max("r").alias("__last")).filter(F.col("__last") >= after)
    blank = shape.select(*keys, F.lit(after + 1).cast("long").alias("r"), F.explode(F.sequence(F.lit(0).cast(kinds["c"]), F.col("__w"))).alias("c"), F.lit("").alias("text"))
    moved = cells.join(shape.select(*keys, F.lit(1).alias("__has")), keys, "left")
    moved = moved.withColumn("r", F.when(F.col("__has").isNotNull() & (F.col("r") > after), F.col("r") + 1).otherwise(F.col("r")).cast("long"))
    return moved.select(*keys, "r", "c", "text").unionByName(blank)


def delete_row(cells: DataFrame, keys: list[str], at: int) -> DataFrame:
    """Without row `at` of every table; a table's only row stays."""
    only = F.max("r").over(W.partitionBy(*keys)) == 0
    kept = cells.withColumn("__only", only).filter((F.col("r") != at) | F.col("__only"))
    return kept.withColumn("r", F.when((F.col("r") > at) & ~F.col("__only"), F.col("r") - 1).otherwise(F.col("r")).cast("long")).drop("__only")


def reverse(items: DataFrame, keys: list[str], index: str) -> DataFrame:
    """All items of every group in the opposite order."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return items.withColumn(index, (n - 1 - F.col(index)).cast("long"))


def slide_sizes(sizes: DataFrame) -> DataFrame:
    """EMU sizes to inches and pixels (914400 and 9525 a unit)."""
    return sizes.withColumns({"width_in": F.col("cx") / 914400, "height_px": F.col("cy") / 9525, "text": number_text(F.col("cx") / 914400)})
