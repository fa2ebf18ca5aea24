import datetime as dt
import io
import math
import random
import zipfile
import zlib

import pyarrow as pa
import pytest

from folioframe.operators import cells as C
from folioframe.operators import layout
from folioframe.sources import files, package, pdf, sheets, texts, writers

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, (k, t) in targets.items()) + "</Relationships>"


SHEET = """<worksheet><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c><v>9</v></c></row>
<row><c r="A2"><v>12.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="e"><v>#DIV/0!</v></c><c r="D2" s="1"><v>45000.5</v></c></row>
<row r="5"><c r="A5"><f>B2*2</f><v>25</v></c><c r="B5"><v/></c><c r="C5"><v>junk</v></c><c r="D5" t="s"><v>99</v></c></row>
%s</sheetData></worksheet>"""


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    write(folder / "a.xlsx", {
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/><sheet name="Lost" sheetId="3" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1=("worksheet", "worksheets/s1.xml"), r2=("worksheet", "/xl/worksheets/s2.xml"), r3=("sharedStrings", "strings.xml"), r4=("styles", "styles.xml")),
        "xl/worksheets/s1.xml": SHEET % "", "xl/worksheets/s2.xml": SHEET % '<row r="9"><c r="A9"><v>1</v></c></row><row r="x">',
        "xl/strings.xml": "<sst><si><t>Shared &amp; text</t></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/_rels/s1.xml.rels": rels(t=("table", "../tables/t1.xml")),
        "xl/tables/t1.xml": '<table id="1" name="T" displayName="T1" ref="A1:B2"><tableColumns><tableColumn name="x"/><tableColumn name="y"/></tableColumns></table>',
    })
    (folder / "bad.xlsx").write_bytes(b"PK\x03\x04 no zip")
    write(folder / "doctype.xlsx", {"xl/workbook.xml": "<!DOCTYPE x><workbook/>"})
    return str(folder)


def test_cells_of_every_kind(spark, book):
    got = {r.ref: r for r in sheets.read_cells(spark, book, sheet="One").collect()}
    assert len(got) == 10  # the cell without a reference is dropped
    assert got["A1"].str == "Shared & text" and got["B1"].str == "inline" and got["D5"].str is None and got["D5"].value_type == "string"
    assert got["A2"].row == 2 and got["A2"].num == 12.5 and got["B2"].bool is True and got["C2"].str == "#DIV/0!"
    assert got["D2"].value_type == "date" and got["D2"].ts == dt.datetime(2023, 3, 15, 12)
    assert got["A5"].formula == "B2*2" and got["B5"].num == 0.0 and math.isnan(got["C5"].num)


def test_range_stops_before_broken_rows(spark, book):
    assert sheets.read_cells(spark, book, sheet="Two", rng="A1:B2").count() == 4
    assert sheets.read_cells(spark, book, sheet="Two").count() == 0  # the whole sheet cannot be read
    grid = C.grid(sheets.read_cells(spark, book, "One", "A1:B2"), "A1:B2").orderBy("row").collect()
    assert [[c["value"] if c else None for c in r.cells] for r in grid] == [["Shared & text", "inline"], ["12.5", None]]


def test_sheets_tables_parts_and_bad_files(spark, book):
    assert [tuple(r)[1:4] + (r.state,) for r in sheets.read_sheets(spark, book).orderBy("pos").collect()] == [(0, "One", 1, "visible"), (1, "Two", 2, "hidden")]
    t = sheets.read_tables(spark, book).first()
    assert (t.name, t.ref, t.columns) == ("T1", "A1:B2", ["x", "y"])
    parts = package.read_parts(spark, book).filter("part = 'xl/strings.xml'").first()
    assert parts.crc == zlib.crc32(b"<sst><si><t>Shared &amp; text</t></si></sst>") and not parts.encrypted
    assert [r.file_id.rsplit("/", 1)[-1] for r in package.bad_files(spark, book).collect()] == ["bad.xlsx"]
    info = {r.path.rsplit("/", 1)[-1]: r for r in files.file_info(spark, book).collect()}
    assert info["a.xlsx"].kind == "zip" and not info["a.xlsx"].mismatch
    assert files.list_files(spark, book, ["xlsx"]).count() == 3


def test_zip_bomb_is_refused():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", bytes(8 << 20))
    with pytest.raises(ValueError):
        package.Package(raw.getvalue())


def test_document(spark, tmp_path):
    body = """<w:document xmlns:w="w"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:outlineLvl w:val="0"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Title</w:t></w:r></w:p>
<w:p><w:commentRangeStart w:id="0"/><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t><w:br/></w:r><w:ins w:id="1" w:author="A" w:date="d"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2" w:author="B"><w:r><w:delText>old</w:delText></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Month</w:t></w:r></w:p></w:tc><w:tc><w:p/><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"""
    write(tmp_path / "a.docx", {"word/document.xml": body, "word/comments.xml": '<w:comments xmlns:w="w"><w:comment w:id="0" w:author="C"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment><w:comment w:id="7"/></w:comments>'})
    p = texts.read_paragraphs(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.text, r.style, r.outline_level, r.has_bold_run, r.run_count) for r in p] == [("Title", "Heading1", 0, True, 1), ("One\ttwo\nnew", None, None, False, 3)]
    assert [(r.text, r.paragraphs) for r in texts.read_table_cells(spark, str(tmp_path)).orderBy("c").collect()] == [("Month", 1), ("\n", 2)]
    assert [(r.text, r.anchored_paragraph) for r in texts.read_comments(spark, str(tmp_path)).orderBy("id").collect()] == [("why", 1), ("", -1)]
    assert sorted((r.type, r.author, r.text) for r in texts.read_revisions(spark, str(tmp_path)).collect()) == [("del", "B", "old"), ("ins", "A", "new")]


def test_deck(spark, tmp_path):
    shape = lambda n, t: f'<p:sp><p:nvSpPr><p:cNvPr name="{n}"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda inner, show="": f'<p:sld xmlns:p="p" xmlns:a="a" {show}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    write(tmp_path / "a.pptx", {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(a=("slide", "slides/s1.xml"), b=("slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": slide(shape("x", "late"), 'show="0"'),
        "ppt/slides/s2.xml": slide(shape("t", "first") + f'<p:grpSp><p:nvGrpSpPr><p:cNvPr name="g"/></p:nvGrpSpPr>{shape("in", "deep")}</p:grpSp>'),
        "ppt/slides/_rels/s2.xml.rels": rels(n=("notesSlide", "../notes/n.xml")), "ppt/notes/n.xml": '<p:notes xmlns:p="p" xmlns:a="a"><a:t>say</a:t></p:notes>',
    })
    got = texts.read_shapes(spark, str(tmp_path)).orderBy("slide", "pos").collect()
    assert [(r.slide, r.type, r.text, r.depth, r.hidden, r.notes) for r in got] == [(0, "shape", "first", 0, False, "say"), (0, "group", "", 0, False, "say"), (0, "shape", "deep", 1, False, "say"), (1, "shape", "late", 0, True, None)]


def make_pdf(contents):
    """A file with one page for each content stream, streams deflated."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /MediaBox [0 0 612 792] /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(contents))) + b"] /Count %d >>" % len(contents)]
    for i, c in enumerate(contents):
        z = zlib.compress(c)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents %d 0 R >>" % (4 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n"


def test_pdf_text_tables_and_objects(spark, tmp_path):
    grid = b"BT /F1 10 Tf 50 700 Td (Month) Tj 150 0 Td (Amount \\(x\\)) Tj -150 -14 Td [(M) -50 (ay)] TJ 150 0 Td <3132> Tj ET"
    (tmp_path / "a.pdf").write_bytes(make_pdf([grid, b"BT /F1 12 Tf 14 TL 1 0 0 1 50 700 Tm (one) Tj T* (two) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    pages = pdf.read_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.page, r.width_pt, r.rotation, r.text) for r in pages] == [(0, 612.0, 90, "MonthAmount (x)\nMay12"), (1, 612.0, 90, "one\ntwo")]
    runs = pdf.read_runs(spark, str(tmp_path)).selectExpr("crc32(file_id) AS doc_id", "page", "text", "x", "y", "font_size")
    assert [r.cells for r in layout.extract_tables(runs).orderBy("r").collect()] == [["Month", "Amount (x)"], ["May", "12"]]
    kinds = {r.key: r for r in pdf.read_objects(spark, str(tmp_path)).collect()}
    assert kinds["3 0"].kind == "Page" and kinds["3 0"].refs == ["2 0", "4 0"] and len(kinds) == 6


def test_character_maps():
    cmap = pdf.unicode_map(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <0002> <0003> <4E00> endbfrange")
    assert cmap == {1: "A", 2: "一", 3: "丁"}
    assert pdf._decode(b"\x00\x02\x01", cmap) == "一A"


def sheet_of(rows):
    return "<worksheet><sheetData>" + rows + "</sheetData></worksheet>"


def one_sheet(body):
    return writers.package({"xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(r1=("worksheet", "worksheets/s1.xml"), r4=("styles", "styles.xml")), "xl/worksheets/s1.xml": body, "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="14"/></cellXfs></styleSheet>'})


def test_a_file_is_read_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Also if it breaks behind many rows, and if its rows are too many to hold."""
    many = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 20_001))
    (tmp_path / "broken.xlsx").write_bytes(one_sheet(sheet_of(many)[:-40]))
    (tmp_path / "sound.xlsx").write_bytes(one_sheet(sheet_of(many)))
    got = sheets.read_cells(spark, str(tmp_path))
    assert {r.file_id.rsplit("/", 1)[-1]: r["count"] for r in got.groupBy("file_id").count().collect()} == {"sound.xlsx": 20_000}
    assert [(r.file_id.rsplit("/", 1)[-1], r.error) for r in package.unreadable(spark, str(tmp_path), sheets.parse_cells()).collect()] == [("broken.xlsx", "ParseError")]
    monkeypatch.setattr(package, "HELD", 10_000)
    arrow = pa.schema([("n", pa.int64())])
    assert sum(b.num_rows for b in package._sound_batches(lambda: ((i,) for i in range(30_000)), ["n"], arrow)) == 30_000
    assert list(package._sound_batches(lambda: ((1 // (29_999 - i),) for i in range(30_000)), ["n"], arrow)) == []


def test_odd_cells_and_locked_parts_do_not_end_the_query(spark, tmp_path):
    (tmp_path / "far.xlsx").write_bytes(one_sheet(sheet_of('<row r="1"><c r="A1" s="0"><v>1e12</v></c><c r="B1" s="0"><v>1</v></c></row>')))
    locked = bytearray(one_sheet(sheet_of("")))
    for i in range(len(locked) - 4):  # set the encryption bit of all local and central headers
        if locked[i : i + 4] == b"PK\x03\x04":
            locked[i + 6] |= 1
        elif locked[i : i + 4] == b"PK\x01\x02":
            locked[i + 8] |= 1
    (tmp_path / "locked.xlsx").write_bytes(bytes(locked))
    cells = sheets.read_cells(spark, str(tmp_path)).orderBy("col").collect()
    assert [(r.value_type, r.num, r.ts) for r in cells] == [("date", 1e12, None), ("date", 1.0, dt.datetime(1899, 12, 31))]
    assert [(r.file_id.rsplit("/", 1)[-1], r.error) for r in package.unreadable(spark, str(tmp_path), sheets.parse_cells()).collect()] == [("locked.xlsx", "RuntimeError")]


def test_listing_says_what_it_leaves_out(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", "d/e/c.txt", "d/.hidden.txt"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    root = str(tmp_path / "root")
    assert {(r.path.rsplit("/", 1)[-1], r.depth, r.total, r.truncated) for r in files.list_files(spark, root).collect()} == {("a.txt", 0, 3, False), ("b.txt", 1, 3, False), ("c.txt", 2, 3, False)}
    assert [(r.path.rsplit("/", 1)[-1], r.total, r.truncated) for r in files.list_files(spark, root, limit=1).collect()] == [("a.txt", 3, True)]
    assert files.list_files(spark, root, max_depth=1).count() == 2
    assert files.safe_path("/data", "a/../b.txt") == "/data/b.txt"
    for bad in ("../x", "/etc/passwd", "a/../../x", "s3://x", "a\0b"):
        with pytest.raises(ValueError):
            files.safe_path("/data", bad)


def test_row_predictors():
    rng = random.Random(2)
    rows = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(9)]
    for pixel in (1, 3):
        out, above = b"", bytes(12)
        for k, row in enumerate(rows):
            kind, coded = k % 5, bytearray()
            for i, x in enumerate(row):
                left, top, corner = row[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
                guess = left + top - corner
                paeth = min((abs(guess - left), 0, left), (abs(guess - top), 1, top), (abs(guess - corner), 2, corner))[2]
                coded.append((x - (0, left, top, (left + top) // 2, paeth)[kind]) & 255)
            out, above = out + bytes([kind]) + bytes(coded), row
        assert pdf.unpredicted(out, 15, 12 // pixel, pixel, 8) == b"".join(rows)
    assert pdf.unpredicted(bytes([1, 1, 1, 5, 250, 1]), 2, 3, 1, 8) == bytes([1, 2, 3, 5, 255, 0]) and pdf.unpredicted(b"x", 1, 1, 1, 8) == b"x"


def test_limits_of_pdf_files_raise():
    loop = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [2 0 R] >>\nendobj\n"
    with pytest.raises(ValueError):
        pdf.Document(loop).pages()


def test_pdf_notes_forms_and_images(spark, tmp_path):
    made = writers.pdf([{"lines": ["a (b)"], "notes": [("Text", "n1"), ("Highlight", "n2")]}], [{"name": "t", "type": "Tx", "value": "v"}, {"name": "b", "type": "Btn", "options": ["Yes"], "value": "Yes", "read_only": True}])
    picture = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /Filter /DCTDecode /Length 3 >>\nstream\nabc\nendstream"
    made = made.replace(b"/Contents 3 0 R", b"/Resources << /XObject << /I 90 0 R /J 91 0 R >> >> /Contents 3 0 R") + b"90 0 obj\n" + picture + b"\nendobj\n91 0 obj\n" + picture.replace(b"DCT", b"CCITTFax") + b"\nendobj\n"
    (tmp_path / "a.pdf").write_bytes(made)
    assert [(r.page, r.kind, r.contents, r.rect) for r in pdf.read_annotations(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "Text", "n1", [10.0, 10.0, 30.0, 30.0]), (0, "Highlight", "n2", [10.0, 10.0, 30.0, 30.0])]
    assert [(r.field, r.type, r.value, r.options, r.read_only) for r in pdf.read_fields(spark, str(tmp_path)).orderBy("field").collect()] == [("b", "button", "Yes", ["Yes"], True), ("t", "text", "v", [], False)]
    assert [(r.object_key, r.name, r.width, r.format, r.skipped) for r in pdf.read_images(spark, str(tmp_path)).orderBy("name").collect()] == [("90 0", "I", 2, "jpg", None), ("91 0", "J", 2, None, "filter CCITTFaxDecode")]
    assert pdf.read_pages(spark, str(tmp_path)).first().text == "a (b)"
