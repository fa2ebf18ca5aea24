"""Registered queries over real files: the nation and region tables are written as workbooks, documents, decks and PDF files, and read back.

Both tables are small by definition (25 and 5 rows), so the files are made on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _query
from .operators import cells as C
from .operators import objects, worksheets
from .sources import files, package, pdf, sheets, texts, writers

_N = "n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, * FROM nation)"
_R = "r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, * FROM region)"
_CELLS = f"""{_N}, cells AS (SELECT 1 AS row, c AS col, h AS str, CAST(NULL AS DOUBLE) AS num, NULL AS formula FROM (VALUES (1, 'key'), (2, 'name & "more"'), (3, 'region'), (4, 'twice')) v(c, h)
 UNION ALL SELECT i + 2, 1, NULL, n_nationkey, NULL FROM n UNION ALL SELECT i + 2, 2, n_name, NULL, NULL FROM n
 UNION ALL SELECT i + 2, 3, NULL, n_regionkey, NULL FROM n UNION ALL SELECT i + 2, 4, NULL, 2 * n_nationkey, 'A' || (i + 2) || '*2' FROM n)"""


def _nations(t) -> list:
    return t.nation.orderBy("n_nationkey").collect()


def _regions(t) -> list[tuple]:
    own = {}
    for n in _nations(t):
        own.setdefault(n.n_regionkey, []).append(n.n_name)
    return [(r.r_regionkey, r.r_name, own.get(r.r_regionkey, [])) for r in t.region.orderBy("r_regionkey").collect()]


def _folder(t, **contents: bytes) -> str:
    """A folder with the files, whose names end behind the last underscore."""
    folder = writers.scratch(t.spark)
    for name, content in contents.items():
        writers.save(t.spark, f"{folder}/{'.'.join(name.rsplit('_', 1))}", content)
    return folder


def _book(t) -> str:
    rows = [["key", 'name & "more"', "region", "twice"]]
    rows += [[n.n_nationkey, n.n_name, n.n_regionkey, (f"A{i}*2", 2 * n.n_nationkey)] for i, n in enumerate(_nations(t), 2)]
    return _folder(t, nations_xlsx=writers.workbook({"Nations": rows, "It's 2": [[1, "x"], [None, 2.5]]}))


def _document(t) -> str:
    nations = _nations(t)
    paragraphs = []
    for i, n in enumerate(nations):
        p = {"text": f"{n.n_name} <{n.n_nationkey}>"}
        if i % 5 == 0:
            p["style"] = "Heading1"
        if i % 4 == 1:
            p["comment"] = n.n_nationkey
        if i % 3 == 2:
            p |= {"inserted": (f" new {n.n_nationkey}", "Ann"), "deleted": (f"old {n.n_nationkey}", "Bob")}
        paragraphs.append(p)
    comments = [{"id": n.n_nationkey, "author": "Ann", "text": f"why {n.n_name}?"} for n in nations if n.n_nationkey % 2 == 1]
    tables = [[[name, *own[:2]] for _, name, own in _regions(t)]]
    return _folder(t, nations_docx=writers.document(paragraphs, tables, comments))


def _name(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.substring_index("file_id", "/", -1)).drop("file_id")


@_query("file_sheet_cells", f"WITH {_CELLS} SELECT 'nations.xlsx' AS file, row, col, chr(64 + col) || row AS ref, CASE WHEN str IS NULL THEN 'number' ELSE 'string' END AS value_type, num, str, formula FROM cells")
def _(t):
    """office_read_sheet of a workbook file: shared strings, numbers, formulas with their values."""
    return _name(sheets.read_cells(t.spark, _book(t), sheet="Nations")).select("file", "row", "col", "ref", "value_type", "num", "str", "formula")


@_query("file_sheet_page", f"WITH {_CELLS} SELECT chr(64 + col) || row AS ref, count(*) OVER () AS total, count(*) OVER () > 17 AS truncated FROM cells QUALIFY row_number() OVER (ORDER BY row, col) BETWEEN 11 AND 17")
def _(t):
    """office_read_sheet (offset 10, limit 7, at most 100,000 cells) of a workbook file."""
    return C.read_sheet(sheets.read_cells(t.spark, _book(t), sheet="Nations"), 10, 7, 100_000).select("ref", "total", "truncated")


@_query("file_sheet_range", f"WITH {_CELLS} SELECT chr(64 + col) || row AS ref, num, str FROM cells WHERE row BETWEEN 2 AND 6 AND col BETWEEN 1 AND 2")
def _(t):
    """office_read_range A2:B6 of a workbook file; rows behind it are not read."""
    return sheets.read_cells(t.spark, _book(t), sheet="Nations", rng="A2:B6").select("ref", "num", "str")


@_query("file_range_reference", "SELECT * FROM (VALUES ('A1', 1.0::DOUBLE, NULL), ('B1', NULL, 'x'), ('B2', 2.5, NULL)) v(ref, num, str)")
def _(t):
    """A range reference with a quoted sheet name."""
    return worksheets.resolve_range(sheets.read_cells(t.spark, _book(t)), "'It''s 2'!$A$1:B2").select("ref", "num", "str")


@_query("file_workbook", "SELECT 0 AS pos, 'Nations' AS name, 'visible' AS state, count(*) AS n_formulas FROM nation UNION ALL SELECT 1, 'It''s 2', 'visible', 0")
def _(t):
    """office_read_workbook of a workbook file: sheets and their formulas."""
    folder = _book(t)
    formulas = C.count_formulas(sheets.read_cells(t.spark, folder))
    listed = sheets.read_sheets(t.spark, folder).select("pos", "name", "state")
    return listed.join(formulas, F.col("name") == F.col("sheet"), "left").select("pos", "name", "state", F.coalesce("n_formulas", F.lit(0)).alias("n_formulas"))


@_query("file_docx_paragraphs", f"WITH {_N} SELECT i AS idx, n_name || ' <' || n_nationkey || '>' || CASE WHEN i % 3 = 2 THEN ' new ' || n_nationkey ELSE '' END AS text, CASE WHEN i % 5 = 0 THEN 'Heading1' END AS style FROM n")
def _(t):
    """office_read_docx (paragraphs) of a document file: inserted text counts, deleted does not."""
    return texts.read_paragraphs(t.spark, _document(t)).select(F.col("idx").cast("long").alias("idx"), "text", "style")


@_query("file_docx_table", f"""WITH {_R}, w AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey)[1:2] AS w FROM nation GROUP BY 1), c AS (SELECT i AS r, list_prepend(r_name, coalesce(w, [])) AS c FROM r LEFT JOIN w ON k = r_regionkey)
 SELECT r, j - 1 AS c, c[j] AS text FROM c, LATERAL unnest(range(1, len(c) + 1)) u(j)""")
def _(t):
    """office_read_docx (tables) of a document file."""
    return texts.read_table_cells(t.spark, _document(t)).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text")


@_query("file_docx_comments", f"WITH {_N} SELECT n_nationkey AS id, 'Ann' AS author, 'why ' || n_name || '?' AS text, CASE WHEN i % 4 = 1 THEN i ELSE -1 END AS anchored_paragraph FROM n WHERE n_nationkey % 2 = 1")
def _(t):
    """office_read_docx (comments) of a document file, with the paragraphs that they stand at."""
    return texts.read_comments(t.spark, _document(t)).select(F.col("id").cast("long").alias("id"), "author", "text", F.col("anchored_paragraph").cast("long").alias("anchored_paragraph"))


@_query("file_docx_revisions", f"WITH {_N}, v AS (SELECT * FROM n WHERE i % 3 = 2) SELECT i AS paragraph, 'ins' AS type, 'Ann' AS author, ' new ' || n_nationkey AS text FROM v UNION ALL SELECT i, 'del', 'Bob', 'old ' || n_nationkey FROM v")
def _(t):
    """office_read_docx (revisions) of a document file."""
    return texts.read_revisions(t.spark, _document(t)).select(F.col("paragraph").cast("long").alias("paragraph"), "type", "author", "text")


@_query("file_deck_shapes", f"""WITH {_R}, w AS (SELECT n_regionkey AS k, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS w FROM nation GROUP BY 1)
 SELECT i AS slide, 0 AS pos, 'Title' AS name, r_name AS text, i = 2 AS hidden, CASE WHEN i % 2 = 0 THEN 'say ' || r_name END AS notes FROM r
 UNION ALL SELECT i, 1, 'Body', coalesce(w, ''), i = 2, CASE WHEN i % 2 = 0 THEN 'say ' || r_name END FROM r LEFT JOIN w ON k = r_regionkey""")
def _(t):
    """office_read_pptx of a deck file: shapes, hidden slides and notes."""
    slides = [{"shapes": [("Title", name), ("Body", "\n".join(own))], "hidden": i == 2} | ({"notes": f"say {name}"} if i % 2 == 0 else {}) for i, (_, name, own) in enumerate(_regions(t))]
    folder = _folder(t, regions_pptx=writers.deck(slides))
    return texts.read_shapes(t.spark, folder).select(F.col("slide").cast("long").alias("slide"), F.col("pos").cast("int").alias("pos"), "name", "text", "hidden", "notes")


def _paper(t) -> str:
    regions = _regions(t)
    pages = [{"lines": [name, *own], "notes": [("Text", f"see {name}")] * (1 + i % 2)} for i, (_, name, own) in enumerate(regions)]
    fields = [{"name": f"f{n.n_nationkey}", "type": ("Tx", "Ch", "Btn")[n.n_nationkey % 3], "options": () if n.n_nationkey % 3 == 0 else ("Yes", "No"), "value": n.n_name if n.n_nationkey % 3 == 0 else None, "read_only": n.n_nationkey % 7 == 0} for n in _nations(t)]
    return _folder(t, regions_pdf=writers.pdf(pages, fields))


@_query("file_pdf_pages", f"WITH {_R}, w AS (SELECT n_regionkey AS k, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS w FROM nation GROUP BY 1) SELECT i AS page, 612.0::DOUBLE AS width_pt, r_name || coalesce(chr(10) || w, '') AS text FROM r LEFT JOIN w ON k = r_regionkey")
def _(t):
    """office_read_pdf (text) of a PDF file."""
    return pdf.read_pages(t.spark, _paper(t)).select(F.col("page").cast("long").alias("page"), "width_pt", "text")


@_query("file_pdf_annotations", f"WITH {_R} SELECT i AS page, 'Text' AS kind, 'see ' || r_name AS contents, 1 + i % 2 AS n FROM r")
def _(t):
    """office_read_pdf (annotations) of a PDF file, equal ones counted."""
    a = pdf.read_annotations(t.spark, _paper(t))
    return a.groupBy(F.col("page").cast("long").alias("page"), "kind", "contents").agg(F.count(F.lit(1)).alias("n"))


@_query("file_pdf_form", """WITH f AS (SELECT 'f' || n_nationkey AS field, n_nationkey % 3 AS k, n_nationkey % 7 = 0 AS ro, CASE WHEN n_nationkey % 5 < 3 THEN 'Yes' WHEN n_nationkey % 5 = 3 THEN 'Maybe' END AS new FROM nation)
 SELECT field, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'choice' ELSE 'button' END AS type, CASE WHEN new IS NULL THEN 'unchanged' WHEN ro THEN 'read_only' WHEN k = 0 OR new = 'Yes' THEN 'filled' ELSE 'invalid' END AS outcome,
 CASE WHEN NOT ro AND new IS NOT NULL AND (k = 0 OR new = 'Yes') THEN new END AS value FROM f""")
def _(t):
    """office_fill_pdf_form over the fields of a PDF file: options and button states are checked, read-only fields refuse."""
    fields = pdf.read_fields(t.spark, _paper(t)).drop("value").withColumn("name", F.col("field"))
    k = F.col("n_nationkey")
    values = t.nation.select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 5 < 3, "Yes").when(k % 5 == 3, "Maybe").alias("new"))
    filled = objects.fill_form(fields, values, ["name"])
    return filled.join(fields.select("name", "type"), "name").select("field", "type", "outcome", "value")


_BROKEN = {"cut_xlsx": b"PK\x03\x04 no zip", "typed_xlsx": None, "plain_pdf": b"no pdf", "page_html": b"<!DOCTYPE html><p>", "real_pdf": None}


def _mixed(t) -> str:
    typed = writers.package({"xl/workbook.xml": "<!DOCTYPE x><workbook/>"})
    return _folder(t, **(_BROKEN | {"typed_xlsx": typed, "real_pdf": writers.pdf([{"lines": ["x"]}])}))


@_query("file_kinds", "SELECT * FROM (VALUES ('cut.xlsx', 'zip', 'xlsx', false), ('typed.xlsx', 'zip', 'xlsx', false), ('plain.pdf', 'unknown', 'pdf', true), ('page.html', 'html', 'html', false), ('real.pdf', 'pdf', 'pdf', false)) v(file, kind, ext, mismatch)")
def _(t):
    """office_get_file_info of files: kind by the first bytes, and whether the extension fits."""
    return files.file_info(t.spark, _mixed(t)).select(F.substring_index("path", "/", -1).alias("file"), "kind", "ext", "mismatch")


@_query("file_listing", "SELECT * FROM (VALUES ('cut.xlsx', 'xlsx', 4, true), ('plain.pdf', 'pdf', 4, true)) v(file, ext, total, truncated)")
def _(t):
    """office_list_files: the first two of the files with these extensions, with the true total."""
    some = files.list_files(t.spark, _mixed(t), ["xlsx", ".PDF"], limit=2)
    return some.select(F.substring_index("path", "/", -1).alias("file"), "ext", "total", "truncated")


@_query("file_unreadable", "SELECT * FROM (VALUES ('cut.xlsx', 'BadZipFile'), ('typed.xlsx', 'ValueError'), ('plain.pdf', 'BadZipFile'), ('page.html', 'BadZipFile'), ('real.pdf', 'BadZipFile')) v(file, error)")
def _(t):
    """Files that cannot be read as workbooks, with the kind of error; they give no cells."""
    return package.unreadable(t.spark, _mixed(t), sheets.parse_cells()).select(F.substring_index("file_id", "/", -1).alias("file"), "error")


@_query("file_validation", """SELECT * FROM (VALUES ('nations.xlsx', 'required_parts', true, 0), ('nations.xlsx', 'relation_targets', true, 0), ('nations.xlsx', 'part_names', true, 0),
 ('holes.xlsx', 'required_parts', false, 1), ('holes.xlsx', 'relation_targets', false, 2), ('holes.xlsx', 'part_names', false, 1)) v(file, "check", ok, failures)""")
def _(t):
    """office_validate_workbook of files: required parts, targets of relations, names that differ in case only."""
    folder = _book(t)
    links = writers.relations([("r1", "worksheet", "worksheets/none.xml"), ("r2", "styles", "/xl/no.xml"), ("r3", "theme", "theme.xml")])
    writers.save(t.spark, f"{folder}/holes.xlsx", writers.package({"xl/workbook.xml": "<workbook/>", "xl/_rels/workbook.xml.rels": links, "xl/theme.xml": "<x/>", "xl/Theme.xml": "<x/>"}))
    checked = package.validate(package.read_parts(t.spark, folder), package.read_relations(t.spark, folder), ["xl/workbook.xml", "_rels/.rels"])
    return _name(checked).withColumn("failures", F.col("failures").cast("int"))


@_query("file_safety", "SELECT * FROM (VALUES ('plain.xlsx', false, false, false, 5), ('risky.xlsm', true, true, false, 3)) v(file, macros, external_links, encrypted, n_parts)")
def _(t):
    """office_get_file_info of workbooks: what asks for care."""
    risky = writers.package({"xl/workbook.xml": "<workbook/>", "xl/vbaProject.bin": b"x", "xl/externalLinks/externalLink1.xml": "<x/>"})
    folder = _folder(t, plain_xlsx=writers.workbook({"S": [[1]]}), risky_xlsm=risky)
    return _name(package.safety(package.read_parts(t.spark, folder))).select("file", "macros", "external_links", "encrypted", F.col("n_parts").cast("int").alias("n_parts"))


@_query("file_pdf_validation", """SELECT * FROM (VALUES ('regions.pdf', 'catalog', true, 0), ('regions.pdf', 'pages', true, 0), ('regions.pdf', 'references', true, 0),
 ('holes.pdf', 'catalog', true, 0), ('holes.pdf', 'pages', false, 1), ('holes.pdf', 'references', false, 2)) v(file, "check", ok, failures)""")
def _(t):
    """office_validate_pdf of files: a catalog, pages, and references that lead somewhere."""
    folder = _paper(t)
    writers.save(t.spark, f"{folder}/holes.pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R /Other 9 0 R >>\nendobj\n")
    return _name(pdf.validate(pdf.read_objects(t.spark, folder))).withColumn("failures", F.col("failures").cast("int"))


@_query("file_protected_markup", f"WITH {_N} SELECT i AS idx, CASE WHEN i % 3 = 2 THEN CASE WHEN i % 4 = 1 THEN 'commentRangeStart,del,ins' ELSE 'del,ins' END WHEN i % 4 = 1 THEN 'commentRangeStart' ELSE '' END AS protected FROM n")
def _(t):
    """office_update_paragraph: markup that an update would lose, by paragraph."""
    tags = texts.read_markup(t.spark, _document(t))
    found = objects.protected_markup(F.col("tags"), ["ins", "del", "commentRangeStart", "hyperlink", "drawing"])
    return tags.select(F.col("idx").cast("long").alias("idx"), F.array_join(found, ",").alias("protected"))
