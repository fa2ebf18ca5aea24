"""Text documents and slide decks."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from .. import model
from .package import Package, attr, child, descendants, local, read_files

_MAIN = "word/document.xml"


def paragraph_text(p: ET.Element) -> str:
    """Text of runs, tabs and breaks in place; deleted text and properties are left out."""
    out = []

    def walk(e: ET.Element) -> None:
        for c in e:
            kind = local(c.tag)
            if kind in ("del", "moveFrom", "pPr", "rPr", "delText"):
                continue
            if kind == "t":
                out.append(c.text or "")
            elif kind == "tab":
                out.append("\t")
            elif kind in ("br", "cr"):
                out.append("\n")
            else:
                walk(c)

    walk(p)
    return "".join(out)


def _body(content: bytes) -> tuple[Package, ET.Element]:
    p = Package(content)
    body = child(p.xml(_MAIN), "body")
    if body is None:
        raise ValueError("the document has no body")
    return p, body


def _paragraphs(file_id: str, content: bytes) -> Iterator[tuple]:
    _, body = _body(content)
    for i, e in enumerate(c for c in body if local(c.tag) == "p"):
        props = child(e, "pPr")
        level = attr(child(props, "outlineLvl"), "val")
        runs = list(descendants(e, "r"))
        bold = any((b := child(r, "rPr", "b")) is not None and attr(b, "val", "1") not in ("0", "false") for r in runs)
        yield file_id, i, paragraph_text(e), attr(child(props, "pStyle"), "val"), int(level) if level else None, attr(child(props, "jc"), "val"), child(props, "numPr") is not None, len(runs), bold


def _table_cells(file_id: str, content: bytes) -> Iterator[tuple]:
    _, body = _body(content)
    for t, table in enumerate(descendants(body, "tbl")):
        for r, row in enumerate(descendants(table, "tr")):
            for c, cell in enumerate(x for x in row if local(x.tag) == "tc"):
                ps = [x for x in cell if local(x.tag) == "p"]
                yield file_id, t, r, c, "\n".join(map(paragraph_text, ps)), len(ps)


def _comments(file_id: str, content: bytes) -> Iterator[tuple]:
    p, body = _body(content)
    anchors: dict[str, int] = {}
    for i, e in enumerate(c for c in body if local(c.tag) == "p"):
        for mark in descendants(e, "commentRangeStart", "commentReference"):
            anchors.setdefault(attr(mark, "id", ""), i)
    part = next((t for k, t in p.relations(_MAIN).values() if k == "comments"), "word/comments.xml")
    if part in p:
        for c in descendants(p.xml(part), "comment"):
            yield file_id, int(attr(c, "id", "0")), attr(c, "author"), attr(c, "initials"), attr(c, "date"), "\n".join(paragraph_text(x) for x in descendants(c, "p")), anchors.get(attr(c, "id", ""), -1)


def _revisions(file_id: str, content: bytes) -> Iterator[tuple]:
    _, body = _body(content)
    for i, e in enumerate(c for c in body if local(c.tag) == "p"):
        for r in descendants(e, "ins", "del"):
            yield file_id, local(r.tag), attr(r, "author"), attr(r, "date"), attr(r, "id"), "".join(t.text or "" for t in descendants(r, "t", "delText")), i


def _markup(file_id: str, content: bytes) -> Iterator[tuple]:
    _, body = _body(content)
    for i, e in enumerate(c for c in body if local(c.tag) == "p"):
        yield file_id, i, sorted({local(x.tag) for x in e.iter()} - {"p"})


def _drawings(file_id: str, content: bytes) -> Iterator[tuple]:
    p, body = _body(content)
    rels = p.relations(_MAIN)
    for i, e in enumerate(c for c in body if local(c.tag) == "p"):
        for d in descendants(e, "inline", "anchor"):
            size, blip = child(d, "extent"), next(descendants(d, "blip"), None)
            target = rels.get(attr(blip, "embed", "") or "", (None, None))[1]
            yield file_id, i, local(d.tag), target, int(attr(size, "cx", "0")), int(attr(size, "cy", "0"))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """file_id, idx, tags: the kinds of markup inside each paragraph, for objects.protected_markup."""
    return read_files(spark, path, "file_id string, idx int, tags array<string>", _markup)


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """file_id, idx, kind (inline or anchor), target, cx, cy of the pictures in paragraphs."""
    return read_files(spark, path, "file_id string, idx int, kind string, target string, cx long, cy long", _drawings)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Body paragraphs of text documents; those in tables are read by read_table_cells."""
    return read_files(spark, path, model.PARAGRAPHS, _paragraphs)


def read_table_cells(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, model.TABLE_CELLS, _table_cells)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments with the first paragraph that they are anchored in, -1 for none."""
    return read_files(spark, path, model.COMMENTS, _comments)


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, model.REVISIONS, _revisions)


def _shape_rows(tree: ET.Element, depth: int) -> Iterator[tuple[str, str | None, str, int]]:
    for e in tree:
        kind = local(e.tag)
        if kind not in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp"):
            continue
        name = next((n.get("name") for n in descendants(e, "cNvPr")), None)
        if kind == "grpSp":
            yield "group", name, "", depth
            yield from _shape_rows(e, depth + 1)
        else:
            table = next(descendants(e, "tbl"), None)
            text = "\n".join("".join(t.text or "" for t in descendants(p, "t")) for p in descendants(e, "p")) if table is None else "\n".join("\t".join(" ".join(t.text or "" for t in descendants(c, "t")) for c in descendants(r, "tc")) for r in descendants(table, "tr"))
            yield "table" if table is not None else {"sp": "shape", "pic": "picture", "graphicFrame": "frame", "cxnSp": "connector"}[kind], name, text, depth


def _shapes(file_id: str, content: bytes) -> Iterator[tuple]:
    p = Package(content)
    main = "ppt/presentation.xml"
    rels = p.relations(main)
    for i, e in enumerate(descendants(p.xml(main), "sldId")):
        rid = next((v for k, v in e.attrib.items() if local(k) == "id" and "}" in k), None)
        if rid not in rels or rels[rid][1] not in p:
            continue
        part = rels[rid][1]
        slide = p.xml(part)
        notes_part = next((t for k, t in p.relations(part).values() if k == "notesSlide" and t in p), None)
        notes = "\n".join(t.text or "" for t in descendants(p.xml(notes_part), "t")) if notes_part else None
        tree = child(slide, "cSld", "spTree")
        for pos, (kind, name, text, depth) in enumerate(_shape_rows(tree if tree is not None else [], 0)):
            yield file_id, i, pos, kind, name, text, depth, slide.get("show") == "0", notes


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of slide decks, groups flattened with their depth; hidden and notes are the slide's."""
    return read_files(spark, path, model.SHAPES, _shapes)
