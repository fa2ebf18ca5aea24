"""Workbooks: sheets, cells and named tables."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .. import model
from ..functions.exprs import DATE_FORMAT_IDS, DAY_MS, EPOCH_1900_MS, EPOCH_1904_MS, REF, parse_range
from .package import Package, attr, child, descendants, local, read_files

SHEETS = "file_id string, pos int, name string, sheet_id int, path string, state string"
TABLES = "file_id string, sheet string, id int, name string, ref string, columns array<string>"
_EPOCH = dt.datetime(1970, 1, 1)


def _workbook(p: Package) -> tuple[str, list[tuple[int, str, int, str, str]], bool]:
    main = next((t for k, t in p.relations("").values() if k == "officeDocument"), "xl/workbook.xml") if "_rels/.rels" in p else "xl/workbook.xml"
    root, rels = p.xml(main), p.relations(main)
    sheets = []
    for e in descendants(root, "sheet"):
        rid = attr(e, "id")
        if rid in rels:  # an inner join: sheets without a target are not listed
            sheets.append((len(sheets), e.get("name", ""), int(e.get("sheetId", 0)), rels[rid][1], e.get("state", "visible")))
    props = next(descendants(root, "workbookPr"), None)
    return main, sheets, props is not None and props.get("date1904") in ("1", "true")


def _number(text: str | None) -> float:
    """Text of a number cell: blank is 0, junk is NaN."""
    t = (text or "").strip()
    if not t:
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", t):
        return float(int(t, 16))
    return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else math.nan


def _date_styles(p: Package, part: str | None) -> set[int]:
    """Cell styles that show dates."""
    if part is None or part not in p:
        return set()
    root = p.xml(part)
    codes = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in descendants(root, "numFmt")}

    def is_date(fmt: int) -> bool:
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", codes.get(fmt, ""))
        return fmt in DATE_FORMAT_IDS or bool(re.search("[ymdhs]", bare, re.I)) and "general" not in bare.lower()

    xfs = next(descendants(root, "cellXfs"), [])
    return {i for i, xf in enumerate(xfs) if is_date(int(xf.get("numFmtId", 0)))}


def _texts(e) -> str:
    return "".join(t.text or "" for t in descendants(e, "t"))


def parse_cells(sheet: str | None = None, rng: str | None = None):
    """A parser of workbooks for read_files and unreadable."""
    bounds = parse_range(rng) if rng else None

    def parse(file_id: str, content: bytes) -> Iterator[tuple]:
        p = Package(content)
        main, sheets, old_epoch = _workbook(p)
        rels = {k: t for k, t in p.relations(main).values()}
        epoch = EPOCH_1904_MS if old_epoch else EPOCH_1900_MS
        lazy: dict = {}

        def strings() -> list[str]:  # read once, and only if a cell needs it
            if "s" not in lazy:
                part = rels.get("sharedStrings")
                lazy["s"] = [_texts(si) for si in descendants(p.xml(part), "si")] if part in p else []
            return lazy["s"]

        def dates() -> set[int]:
            if "d" not in lazy:
                lazy["d"] = _date_styles(p, rels.get("styles"))
            return lazy["d"]

        for _, name, _, part, _ in sheets:
            if sheet is not None and name != sheet or part not in p:
                continue
            row, ord_ = 0, 0
            for event, e in p.events(part):
                kind = local(e.tag)
                if kind == "row" and event == "start":
                    row = int(e.get("r") or row + 1)
                    if bounds and row > bounds[3]:
                        break  # rows are stored in order; the rest is not inflated
                elif kind == "row":
                    e.clear()
                elif kind == "c" and event == "end":
                    m = re.match(REF, e.get("r") or "")
                    if not m:
                        continue
                    col, at = reduce(lambda a, c: a * 26 + ord(c) - 64, m[1].upper(), 0), int(m[2])
                    if bounds and not (bounds[0] <= col <= bounds[2] and bounds[1] <= at <= bounds[3]):
                        continue
                    yield file_id, name, at, col, e.get("r"), ord_, *_value(e, strings, dates, epoch)
                    ord_ += 1

    return parse


def _value(e, strings, dates, epoch: int) -> tuple:
    """value_type, num, str, bool, ts, formula, style, raw of a cell element."""
    v, f = child(e, "v"), child(e, "f")
    raw = v.text if v is not None else None
    formula = (f.text or "") if f is not None else None
    style = int(e.get("s")) if e.get("s") else None
    kind = e.get("t", "n")
    if kind == "s":
        i = int(raw) if raw and raw.strip().isdigit() else -1
        return "string", None, strings()[i] if 0 <= i < len(strings()) else None, None, None, formula, style, raw
    if kind in ("str", "inlineStr"):
        text = raw if kind == "str" else _texts(child(e, "is")) if child(e, "is") is not None else ""
        return "string", None, text or "", None, None, formula, style, raw
    if kind == "b":
        return "boolean", None, None, raw == "1", None, formula, style, raw
    if kind == "e":
        return "error", None, raw, None, None, formula, style, raw
    if v is None:
        return None, None, None, None, None, formula, style, raw
    x = _number(raw)
    if style is not None and math.isfinite(x) and style in dates():
        return "date", x, None, None, _instant(x, epoch), formula, style, raw
    return "number", x, None, None, None, formula, style, raw


def _instant(serial: float, epoch: int) -> dt.datetime | None:
    """Null beyond the years that a timestamp can hold; the number stays."""
    try:
        return _EPOCH + dt.timedelta(milliseconds=epoch + math.floor(serial * DAY_MS + 0.5))
    except OverflowError:
        return None


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, rng: str | None = None) -> DataFrame:
    """Cells of workbooks in document order, of one sheet and range if named; rows past it are not read."""
    return read_files(spark, path, model.CELLS.replace("ts timestamp", "ts timestamp_ntz"), parse_cells(sheet, rng))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, SHEETS, lambda file_id, content: ((file_id, *s) for s in _workbook(Package(content))[1]))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Named tables of workbooks with their column names."""

    def parse(file_id: str, content: bytes) -> Iterator[tuple]:
        p = Package(content)
        for _, name, _, part, _ in _workbook(p)[1]:
            for kind, target in p.relations(part).values():
                if kind == "table" and target in p:
                    t = p.xml(target)
                    yield file_id, name, int(t.get("id", 0)), t.get("displayName") or t.get("name"), t.get("ref"), [c.get("name", "") for c in descendants(t, "tableColumn")]

    return read_files(spark, path, TABLES, parse)
