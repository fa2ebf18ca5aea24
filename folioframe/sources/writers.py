"""Small files of every kind from plain rows, written through the cluster's file system; the readers read them back."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession

#: Namespaces of packages, their relations and their markup.
RELS, OFFICE = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD, DRAW, SHOW = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below the checkpoint folder, or a temporary one in a local session."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folioframe-files-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def save(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file to any file system that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(content))
    out.close()


def package(parts: dict[str, str | bytes]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return raw.getvalue()


def relations(targets: Iterable[tuple[str, str, str]]) -> str:
    """(id, kind, target) of each relation."""
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{k}" Target="{t}"/>' for i, k, t in targets) + "</Relationships>"


def _letters(n: int) -> str:
    return ("" if n <= 26 else _letters((n - 1) // 26)) + chr(65 + (n - 1) % 26)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows; a text is shared, a number plain, None empty, a pair (formula, value) a formula with its value."""
    shared: dict[str, int] = {}
    parts, links, listed = {}, [], []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        body = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row, 1):
                ref, formula = f"{_letters(c)}{r}", ""
                if isinstance(v, tuple):
                    formula, v = f"<f>{escape(v[0])}</f>", v[1]
                if isinstance(v, str):
                    cells.append(f'<c r="{ref}" t="s">{formula}<v>{shared.setdefault(v, len(shared))}</v></c>')
                elif v is not None:
                    cells.append(f'<c r="{ref}">{formula}<v>{v}</v></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{''.join(body)}</sheetData></worksheet>"
        links.append((f"r{k}", "worksheet", f"worksheets/sheet{k}.xml"))
        listed.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>')
    parts["xl/workbook.xml"] = f'<workbook xmlns:r="{OFFICE}"><sheets>{"".join(listed)}</sheets></workbook>'
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared) + "</sst>"
    parts["xl/_rels/workbook.xml.rels"] = relations([*links, ("rs", "sharedStrings", "sharedStrings.xml")])
    parts["_rels/.rels"] = relations([("r1", "officeDocument", "xl/workbook.xml")])
    return package(parts)


def document(paragraphs: list[dict], tables: list[list[list[str]]] = (), comments: list[dict] = ()) -> bytes:
    """paragraphs: text, and if wanted style, comment (id), inserted and deleted (text, author). comments: id, author, text."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = []
    for n, p in enumerate(paragraphs):
        inner = f'<w:pPr><w:pStyle w:val={quoteattr(p["style"])}/></w:pPr>' if p.get("style") else ""
        if p.get("comment") is not None:
            inner += f'<w:commentRangeStart w:id="{p["comment"]}"/>'
        inner += run(p["text"])
        for kind, tag in (("inserted", "ins"), ("deleted", "del")):
            if kind in p:
                text, author = p[kind]
                shown = run(text) if tag == "ins" else f"<w:r><w:delText>{escape(text)}</w:delText></w:r>"
                inner += f'<w:{tag} w:id="{n}" w:author={quoteattr(author)}>{shown}</w:{tag}>'
        body.append(f"<w:p>{inner}</w:p>")
    for t in tables:
        body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>")
    notes = "".join(f'<w:comment w:id="{c["id"]}" w:author={quoteattr(c["author"])}><w:p>{run(c["text"])}</w:p></w:comment>' for c in comments)
    return package({
        "_rels/.rels": relations([("r1", "officeDocument", "word/document.xml")]), "word/_rels/document.xml.rels": relations([("r1", "comments", "comments.xml")]),
        "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{"".join(body)}</w:body></w:document>', "word/comments.xml": f'<w:comments xmlns:w="{WORD}">{notes}</w:comments>',
    })


def deck(slides: list[dict]) -> bytes:
    """slides: shapes (name, text), and if wanted notes and hidden."""
    parts, links, ids = {"_rels/.rels": relations([("r1", "officeDocument", "ppt/presentation.xml")])}, [], []
    lines = lambda t: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in t.split("\n"))
    for k, s in enumerate(slides, 1):
        shapes = "".join(f"<p:sp><p:nvSpPr><p:cNvPr id=\"{i}\" name={quoteattr(n)}/></p:nvSpPr><p:txBody>{lines(t)}</p:txBody></p:sp>" for i, (n, t) in enumerate(s["shapes"], 2))
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="{SHOW}" xmlns:a="{DRAW}"{" show=" + quoteattr("0") if s.get("hidden") else ""}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
        if s.get("notes") is not None:
            parts[f"ppt/notesSlides/notes{k}.xml"] = f'<p:notes xmlns:p="{SHOW}" xmlns:a="{DRAW}">{lines(s["notes"])}</p:notes>'
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = relations([("n", "notesSlide", f"../notesSlides/notes{k}.xml")])
        links.append((f"r{k}", "slide", f"slides/slide{k}.xml"))
        ids.append(f'<p:sldId id="{255 + k}" r:id="r{k}"/>')
    parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{SHOW}" xmlns:r="{OFFICE}"><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = relations(links)
    return package(parts)


def _string(t: str) -> str:
    return "(" + t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ")"


def pdf(pages: list[dict], fields: list[dict] = ()) -> bytes:
    """pages: lines, and if wanted notes (kind, text). fields: name, type (Tx, Ch or Btn), value, options, read_only."""
    objects: list[bytes] = [b"", b""]
    put = lambda body: objects.append(body.encode("latin-1") if isinstance(body, str) else body) or len(objects)
    kids = []
    for p in pages:
        shown = "BT /F1 10 Tf 14 TL 50 740 Td " + " T* ".join(f"{_string(t)} Tj" for t in p["lines"]) + " ET"
        z = zlib.compress(shown.encode("latin-1"))
        content = put(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream")
        notes = [put(f"<< /Type /Annot /Subtype /{kind} /Rect [10 10 30 30] /Contents {_string(text)} >>") for kind, text in p.get("notes", ())]
        kids.append(put(f"<< /Type /Page /Parent 2 0 R /Contents {content} 0 R /Annots [{' '.join(f'{n} 0 R' for n in notes)}] >>"))
    entries = []
    for f in fields:
        value = f.get("value")
        shown = "" if value is None else f" /V /{value}" if f["type"] == "Btn" else f" /V {_string(value)}"
        options = f.get("options", ())
        if f["type"] == "Btn":
            extra = "/AP << /N << " + " ".join(f"/{o} null" for o in [*options, "Off"]) + " >> >>"
        else:
            extra = f"/Opt [{' '.join(map(_string, options))}]" if options else ""
        entries.append(put(f"<< /T {_string(f['name'])} /FT /{f['type']} /Ff {int(f.get('read_only', False))}{shown} {extra} >>"))
    objects[0] = f"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [{' '.join(f'{n} 0 R' for n in entries)}] >> >>".encode()
    objects[1] = f"<< /Type /Pages /MediaBox [0 0 612 792] /Kids [{' '.join(f'{n} 0 R' for n in kids)}] /Count {len(kids)} >>".encode()
    out, at = b"%PDF-1.7\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
