"""Lists of worksheets and merged ranges, edited under their rules; range references and number formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import parse_range
from ..model import numbered
from .integrity import SHEET_NAME

#: Number formats that a workbook need not define, by id.
BUILT_IN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Fixed value: the first id of a format that a workbook defines itself.
FIRST_OWN_FORMAT = 164


def _check_name(sheets: DataFrame, name: str, but: str | None = None) -> None:
    if not re.search(SHEET_NAME, name):
        raise ValueError(f"not a sheet name: {name!r}")
    others = sheets if but is None else sheets.filter(F.col("name") != but)
    if not others.filter(F.lower("name") == name.lower()).isEmpty():
        raise ValueError(f"a sheet is called {name!r} already")


def _check_known(sheets: DataFrame, name: str) -> None:
    if sheets.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"no sheet is called {name!r}")


def add_sheet(sheets: DataFrame, name: str, index: int | None = None) -> DataFrame:
    """sheets (pos, name, state) with a visible one at place `index` (behind all without); names are unique, case aside."""
    _check_name(sheets, name)
    kind = sheets.schema["pos"].dataType
    at = sheets.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).select((F.col("n") if index is None else F.least("n", F.lit(max(0, index)))).cast(kind).alias("pos"))
    moved = sheets if index is None else sheets.withColumn("pos", F.when(F.col("pos") >= index, F.col("pos") + 1).otherwise(F.col("pos")).cast(kind))
    return moved.unionByName(at.select("pos", F.lit(name).alias("name"), F.lit("visible").alias("state")))


def rename_sheet(sheets: DataFrame, old: str, new: str) -> DataFrame:
    _check_known(sheets, old)
    _check_name(sheets, new, but=old)
    return sheets.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))


def delete_sheet(sheets: DataFrame, name: str, close_up: bool = True) -> DataFrame:
    """Without the sheet; the last visible one cannot go. Later ones move up, or keep their numbers."""
    _check_known(sheets, name)
    if sheets.filter((F.col("name") != name) & (F.col("state") == "visible")).isEmpty():
        raise ValueError("the last visible sheet cannot be deleted")
    kept = sheets.filter(F.col("name") != name)
    return numbered(kept.drop("pos").join(kept.select("name", F.col("pos").alias("old")), "name"), "old", "pos", 0).select(*sheets.columns) if close_up else kept


def merge_range(merges: DataFrame, rng: str) -> DataFrame:
    """merges (r0, c0, r1, c1) with one more; a range that is merged already, or overlaps one that is, is refused."""
    c0, r0, c1, r1 = parse_range(rng)
    if (r0, c0) == (r1, c1):
        raise ValueError("a merged range has two cells at least")
    if not merges.filter((F.col("r0") <= r1) & (F.col("r1") >= r0) & (F.col("c0") <= c1) & (F.col("c1") >= c0)).isEmpty():
        raise ValueError(f"{rng} overlaps a merged range")
    kinds = dict(merges.dtypes)
    new = merges.sparkSession.range(1).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in (("r0", r0), ("c0", c0), ("r1", r1), ("c1", c1))])
    return merges.select("r0", "c0", "r1", "c1").unionByName(new)


def parse_sheet_range(text: str, default: str | None = None) -> tuple[str | None, tuple[int, int, int, int]]:
    """(sheet, bounds) of Sheet!A1:B2; a name in quotes may hold anything, its own quotes doubled."""
    m = re.fullmatch(r"(?:'((?:[^']|'')+)'|([^'!]+))!(.+)|(.+)", text.strip(), re.S)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    sheet = m[1].replace("''", "'") if m[1] else m[2] or default
    return sheet, parse_range(m[3] or m[4])


def resolve_range(cells: DataFrame, text: str, default: str | None = None) -> DataFrame:
    """The cells (with their sheet) that a range reference names; a sheet without cells is unknown."""
    sheet, (c0, r0, c1, r1) = parse_sheet_range(text, default)
    own = cells.filter(F.col("sheet") == sheet) if sheet is not None else cells
    if sheet is not None and own.isEmpty():
        raise ValueError(f"no sheet is called {sheet!r}")
    return own.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def format_ids(codes: DataFrame, defined: DataFrame) -> DataFrame:
    """code -> id: built-in, else as the workbook defines it (id, code), else new ones from the first free id on."""
    spark = codes.sparkSession
    built_in = F.broadcast(spark.createDataFrame([(c, i) for i, c in BUILT_IN_FORMATS.items()], "code string, b int"))
    own = defined.groupBy("code").agg(F.min("id").cast("int").alias("o"))
    found = codes.select("code").distinct().join(built_in, "code", "left").join(own, "code", "left").select("code", F.coalesce("b", "o").alias("id"))
    next_id = max(FIRST_OWN_FORMAT, (defined.agg(F.max("id")).first()[0] or 0) + 1)
    # formats are few: a workbook cannot hold more than 2^16 of them
    new = numbered(found.filter("id IS NULL").select("code", F.lit(0).alias("k")), "k", "id", next_id).select("code", F.col("id").cast("int").alias("id"))
    return found.filter("id IS NOT NULL").unionByName(new)
