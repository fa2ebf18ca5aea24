"""Canonical schemas, and views of ordinary tables as sheets, documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions.exprs import a1

CELLS = "file_id string, sheet string, row int, col int, ref string, ord long, value_type string, num double, str string, bool boolean, ts timestamp, formula string, style int, raw string"
PARAGRAPHS = "file_id string, idx int, text string, style string, outline_level int, alignment string, is_list_item boolean, run_count int, has_bold_run boolean"
TABLE_CELLS = "file_id string, tbl int, r int, c int, text string, paragraphs int"
COMMENTS = "file_id string, id int, author string, initials string, date string, text string, anchored_paragraph int"
REVISIONS = "file_id string, type string, author string, date string, id string, text string, paragraph int"
SHAPES = "file_id string, slide int, pos int, type string, name string, text string, depth int, hidden boolean, notes string"
PAGES = "file_id string, page int, width_pt double, height_pt double, rotation int, text string"
RUNS = "file_id string, page int, ord int, text string, x double, y double, font_size double"
PARTS = "file_id string, part string, method int, crc long, comp_size long, uncomp_size long, encrypted boolean, sha256 string"

#: Paragraphs of a page when text is paged; keys of a bucket in row numbering.
PAGE_LINES, KEY_BUCKET = 40, 1 << 16


def numbered(df: DataFrame, key: str, out: str = "row", first: int = 1) -> DataFrame:
    """Consecutive numbers in the order of an integer key, null keys first; rows of equal keys by their other columns.

    Buckets, of a width that suits the span of the keys, are counted; their running offsets are added
    to the numbers inside a bucket, so no task sees much more than a bucket, however sparse the keys.
    Rows equal in all columns may take each other's numbers.
    """
    low, high, n = df.agg(F.min(key).cast("long"), F.max(key).cast("long"), F.count(F.lit(1))).first()
    width = max(1, (high - low + 1) * KEY_BUCKET // max(n, KEY_BUCKET)) if low is not None else 1
    d = df.withColumn("__b", F.expr(f"(cast(`{key}` as decimal(20,0)) - {low or 0}) div {width}"))
    counts = d.groupBy(F.col("__b").alias("__cb")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy(F.col("__cb").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__cb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    kinds = dict(df.dtypes)
    ties = [c for c in df.columns if c != key and not kinds[c].startswith("map")]
    inside = F.row_number().over(W.partitionBy("__b").orderBy(key, *ties))
    joined = d.withColumn("__i", inside).join(counts, F.col("__b").eqNullSafe(F.col("__cb")))
    return joined.withColumn(out, (F.col("__o") + F.col("__i") - 1 + first).cast("long")).drop("__b", "__cb", "__o", "__i")


def sheet(df: DataFrame, key: str, columns: list[str], first_row: int = 2) -> DataFrame:
    """A table as the cells of a sheet below a header row: row, col, ref, ord, value_type, num, str."""
    rows = numbered(df.select(*dict.fromkeys([key, *columns])), key, "row", first_row)
    kinds = dict(df.dtypes)
    cells = []
    for i, c in enumerate(columns, 1):
        is_num = kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        text = F.col(c).cast("string")
        cells.append(F.struct(F.lit(i).alias("col"), F.lit("number" if is_num else "string").alias("value_type"), (F.col(c).cast("double") if is_num else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if is_num else text).alias("str")))
    out = rows.select("row", F.inline(F.array(*cells)))
    return out.withColumn("ref", a1(F.col("col"), F.col("row"))).withColumn("ord", F.col("row") * 16384 + F.col("col")).select("row", "col", "ref", "ord", "value_type", "num", "str")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, idx, text: the lines of each document."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))


def text_pages(documents: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """doc_id, page, text: every `lines` lines of a document, from 0; no shuffle."""
    parts = F.split("text", "\n", -1)
    pages = documents.select("doc_id", parts.alias("p")).select("doc_id", "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / lines).cast("int"))).alias("page"))
    return pages.select("doc_id", "page", F.array_join(F.slice("p", F.col("page") * lines + 1, F.lit(lines)), "\n").alias("text"))


def value_text(num: Column, text: Column) -> Column:
    from .functions.exprs import number_text

    return F.coalesce(text, number_text(num))
