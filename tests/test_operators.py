import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioframe import catalog, model
from helpers import DATA
from folioframe.functions import exprs as X
from folioframe.operators import cells as C
from folioframe.operators import diff, graph, integrity, layout, objects, search, worksheets
from folioframe.operators import sequences as S
from folioframe.plans import plans
from folioframe.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hits_are_where_they_say(spark):
    texts = [(1, 0, "The the\nthe END"), (2, 0, None), (3, 0, ""), (4, 0, "a.b A.B axb")]
    pages = spark.createDataFrame(texts, "doc_id long, page int, text string")
    by = {r.doc_id: r for r in pages.collect()}
    for needle, n in (("the", 3), ("a.b", 2)):
        hits = search.search(pages, needle).collect()
        assert len(hits) == n
        for h in hits:
            assert by[h.doc_id].text[h.offset : h.offset + len(h.match)] == h.match
            assert h.line == by[h.doc_id].text[: h.offset].count("\n") + 1
    assert search.search(pages, "the", max_results=1).first().total_matches == 3
    with pytest.raises(ValueError):
        search.search(pages, "")


def test_literal_replace_takes_needle_and_replacement_as_they_stand(spark):
    df = spark.createDataFrame([("É $1 \\E x", 1)], "s string, i int")
    assert df.select(X.literal_replace(F.col("s"), "é", "$0\\")).first()[0] == "$0\\ $1 \\E x"
    assert df.select(X.literal_replace(F.col("s"), "\\E", "-")).first()[0] == "É $1 - x"
    assert df.select(X.literal_replace(F.col("s"), "$1", "b", match_case=True)).first()[0] == "É b \\E x"


@pytest.mark.parametrize("x, text", [(42.0, "42"), (12345678.9, "12345678.9"), (1e21, "1e+21"), (-0.5, "-0.5"), (1e-7, "1e-7"), (float("nan"), "NaN"), (0.0, "0"), (1.5e300, "1.5e+300")])
def test_number_text(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(X.number_text(F.col("x"))).first()[0] == text


def test_references(spark):
    assert X.parse_range("$D20:A1") == (1, 1, 4, 20)
    with pytest.raises(ValueError):
        X.parse_range("A")
    df = spark.createDataFrame([("XFD1",), ("$b$7",), ("AAAA1",), ("7",), (None,)], "r string")
    col, row = X.parse_ref(F.col("r"))
    assert [tuple(x) for x in df.select(col, row).collect()] == [(16384, 1), (2, 7), (None, None), (None, None), (None, None)]


def test_dense_range_keeps_the_last_duplicate_and_refuses_large_ones(spark):
    cells = spark.createDataFrame([(1, 1, "A1", 1, "number", 1.0, None), (1, 1, "A1", 2, "number", 2.0, None)], "row long, col int, ref string, ord long, value_type string, num double, str string")
    grid = C.grid(cells, "A1:B2").orderBy("row").collect()
    assert [[c and c["value"] for c in r.cells] for r in grid] == [["2", None], [None, None]]
    with pytest.raises(ValueError):
        C.grid(cells, "A1:XFD100")


def test_csv_file(spark, tmp_path):
    cells = spark.createDataFrame([(1, 1, 1, None, 'a"b'), (1, 3, 2, 2.5, None), (3, 1, 3, None, "z")], "row long, col int, ord long, num double, str string")
    C.write_csv(cells.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().decode("utf-8") == '﻿"a""b",,2.5\r\n\r\nz\r\n'


def naive_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_edit_script_is_a_longest_one():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in "ab")
        ops, aligned = diff.edit_script(a, b)
        assert aligned and sum(o == "equal" for o, _, _ in ops) == naive_lcs(a, b)
        assert [a[i] for o, i, _ in ops if o != "add"] == a and [b[j] for o, _, j in ops if o != "remove"] == b
    assert diff.edit_script(list("ab"), list("cd"), limit=4) == ([("equal", 0, 0), ("equal", 1, 1)], False)


def test_known_document_changes():
    a = [(0, "H", "Title"), (1, None, "The quick brown fox"), (2, None, "Same"), (3, None, "Gone for good")]
    b = [(0, "H", "Title"), (1, None, "New line"), (2, None, "The quick brown foxes"), (3, "Quote", "Same")]
    changes, aligned = diff.compare_sequences(a, b)
    kinds = {(c[0], c[1], c[2]) for c in changes}
    assert aligned and ("text", 1, 2) in kinds and ("add", None, 1) in kinds
    assert any("style" in k for k, _, _ in kinds)
    assert diff.compare_sequences(a, a) == ([], True)
    assert diff.similarity("night", "nacht") == 0.25 and diff.similarity("", "x") == 0.0


def test_keyed_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w")], "k int, v string")
    assert rows(diff.keyed_diff(a, b, ["k"], "v")) == [(1, "changed", "x", "y"), (3, "removed", "z", None), (4, "added", None, "w")]


def test_tables_from_runs_and_none_from_prose():
    grid = [(50.0, 700.0, "Month", 10.0), (200.0, 700.0, "Amount", 10.0), (50.0, 686.0, "May", 10.0), (200.0, 685.5, "12", 10.0)]
    (found,), tolerance = layout.page_tables(grid)
    assert found[0] == [["Month", "Amount"], ["May", "12"]] and tolerance == 6.3
    padded = [(50.0, 700.0 - 14 * i, f"{a:<24}{b}", 10.0) for i, (a, b) in enumerate([("Name", "N"), ("one", "1"), ("two", "2")])]
    assert layout.page_tables(padded)[0][0][0] == [["Name", "N"], ["one", "1"], ["two", "2"]]
    assert layout.page_tables([(50.0, 700.0 - 14 * i, "A line of plain prose here.", 10.0) for i in range(3)])[0] == []


def test_wrap_keeps_words_and_cuts_long_ones():
    assert layout.wrap("aa bb cc", 25) == ["aa bb", "cc"]
    assert layout.wrap("abcdefghij", 20) == ["abcd", "efgh", "ij"]
    assert layout.wrap("", 20) == [""]
    assert layout.wrap("漢字漢字", 20) == ["漢字", "漢字"]


def naive_wrap(line, width, size):
    """The same by measuring the growing line again for each word and cut."""
    if layout.text_width(line, size) <= width:
        return [line]
    out, current = [], ""
    for word in re.findall(r"\s+|\S+", line):
        if current and layout.text_width(current + word, size) > width:
            out.append(current.rstrip())
            current = word.lstrip()
        else:
            current += word
        while len(current) > 1 and layout.text_width(current, size) > width:
            cut = next((k for k in range(len(current) - 1, 1, -1) if layout.text_width(current[:k], size) <= width), 1)
            out.append(current[:cut])
            current = current[cut:]
    if current:
        out.append(current.rstrip())
    return out or [""]


def test_wrapping_by_prefix_widths():
    rng = random.Random(8)
    for _ in range(3000):
        line = "".join(rng.choice("abcde      \t漢字ｱ。é") * rng.randint(1, 4) for _ in range(rng.randint(0, 30)))
        width, size = rng.choice([5, 17.5, 40, 99.9, 480]), rng.choice([10, 7, 12.5])
        assert layout.wrap(line, width, size) == naive_wrap(line, width, size), (line, width, size)


def test_every_wrapped_line_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = []
    for d in docs.collect():
        page = 0
        for part in (d.text or "").split("\f"):
            lines = [w for line in part.split("\n") for w in naive_wrap(line, 480.0, 10)]
            want += [(d.doc_id, page + i // 50, i % 50, t) for i, t in enumerate(lines)]
            page += max(1, -(-len(lines) // 50))
    assert rows(layout.paginate(docs, 480.0, 50)) == sorted(want, key=str)


def test_changes_rebuild_the_edited_document(spark):
    """What the comparison reports turns every first version into the second, and nothing is reported twice."""
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 4)))
    first, second = {}, {}
    for pair in range(60):
        a = [(rng.choice([None, "H"]), line()) for _ in range(rng.randint(0, 9))]
        b = [x for x in a if rng.random() > 0.2]
        b = [(s, t + " more") if rng.random() < 0.2 else (s, t) for s, t in b]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), (None, line()))
        first[pair], second[pair] = a, b
    make = lambda v: spark.createDataFrame([(k, i, s, t) for k, x in v.items() for i, (s, t) in enumerate(x)], "pair_id long, idx int, style string, text string").repartition(5)
    found = {}
    for r in diff.compare_documents(make(first), make(second)).collect():
        assert r.aligned
        found.setdefault(r.pair_id, []).append(r)
    for pair, a in first.items():
        b, changes = second[pair], found.get(pair, [])
        gone, new = {r.index_before for r in changes if r.index_before is not None}, {r.index_after for r in changes if r.index_after is not None}
        assert len(gone) + len(new) == sum((r.index_before is not None) + (r.index_after is not None) for r in changes)
        assert [x for i, x in enumerate(a) if i not in gone] == [x for i, x in enumerate(b) if i not in new]
        for r in changes:
            assert r.index_before is None or (r.style_before, r.text_before) == a[r.index_before]
            assert r.index_after is None or (r.style_after, r.text_after) == b[r.index_after]
        assert (changes == []) == (a == b)


def test_blocks_too_large_to_align_are_marked(spark, monkeypatch):
    monkeypatch.setattr(diff, "MAX_PAIR", 3)
    a, b = [(i, None, f"a{i}") for i in range(2)], [(i, None, f"b{i}") for i in range(2)]
    assert diff.compare_sequences(a, b)[1] is False and diff.compare_sequences(a[:1], b)[1] is True


def test_search_in_long_and_dense_pages(spark):
    """Over many runs of hits, with contexts that reach over other hits and page ends."""
    texts = ["the" * 700, "x\n" * 50 + "The the\n" * 300, "", "theme of the thesis " * 40]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "no hit")], "doc_id long, page int, text string")
    got = search.search(pages, "the", max_results=1000, context=9).collect()
    want = [(i, m.start(), t[: m.start()].count("\n") + 1, m[0], t[max(0, m.start() - 9) : m.start()], t[m.end() : m.end() + 9]) for i, t in enumerate(texts) for m in re.finditer("(?i)the", t)]
    assert len(want) > 1000
    assert sorted((r.page, r.offset, r.line, r.match, r.context_before, r.context_after) for r in got) == want[:1000] and {r.total_matches for r in got} == {len(want)}
    assert [r.context_before for r in search.search(pages, "the", context=0).collect()] == [""] * 100


def test_paginate_breaks_at_form_feeds(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\fd"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in layout.paginate(d, 500.0, 2).orderBy("doc_id", "page", "line").collect()] == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 2, 0, "d"), (2, 0, 0, "")]


def test_reachability_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = graph.reachable(edges, spark.createDataFrame([(1,)], "node long"))
    assert rows(got) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.renumber(got.select("node"))) == [(1, 1), (2, 2), (3, 3)]


def test_reachability_deals_edges_once(spark, monkeypatch):
    """Depths by a plain search; what is shuffled is no multiple of edges and levels, also where nothing is broadcast."""
    n = 20_000
    refs = {k: ((k * 7 + 3) % n, (k * 2 + 1) % n) for k in range(n)}
    depths, level = {1: 0}, [1]
    while level:
        level = sorted({d for k in level for d in refs[k]} - set(depths))
        depths.update(dict.fromkeys(level, max(depths.values()) + 1))
    assert max(depths.values()) > 8
    edges = spark.createDataFrame([(k, d) for k, ds in refs.items() for d in ds], "src long, dst long")
    root = spark.createDataFrame([(1,)], "node long")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert {r.node: r.depth for r in graph.reachable(edges, root).collect()} == depths
        assert shuffled() - before < 10 * 2 * n
        monkeypatch.setattr(graph, "DEALT_LEVELS", 2)
        monkeypatch.setattr(graph, "PARTS", 5)
        assert {r.node: r.depth for r in graph.reachable(edges, root).collect()} == depths
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(RuntimeError):
        graph.reachable(edges, root, 3)


def test_numbering_over_buckets(spark):
    keys = [5, 70_000, 70_001, 200_000]
    assert rows(model.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "n")) == sorted([(k, i) for i, k in enumerate(keys, 1)], key=str)


def test_numbering_of_nulls_repeats_and_sparse_keys(spark):
    got = rows(model.numbered(spark.createDataFrame([(None, "x"), (7, "b"), (7, "a"), (-(10**15), "y"), (10**15, "z"), (None, "w")], "k long, v string"), "k", "n"))
    assert sorted((n, k, v) for k, v, n in got) == [(1, None, "w"), (2, None, "x"), (3, -(10**15), "y"), (4, 7, "a"), (5, 7, "b"), (6, 10**15, "z")]
    assert model.numbered(spark.createDataFrame([], "k long"), "k", "n").count() == 0


def test_plain_text_is_passed_by_quickly(spark):
    """Over 8 million plain characters, against the full class tried at each of them."""
    odd = "x\u0100y\t€z\u0400\u0100\x7f\x80\xa0ÿ\U0001f600\x00é\u0400"
    got = spark.createDataFrame([(odd,), ("",), (None,)], "s string").select(X.unencodable(F.col("s")).alias("u")).collect()
    assert [r.u for r in got] == [["\u0100", "\u0400", "\x7f", "\x80", "\U0001f600", "\x00"], [], None]
    long = spark.range(0, 80, 1, 1).select(F.concat(F.repeat(F.lit("plain, "), 100_000 // 7), F.lit("\u0100")).alias("s")).localCheckpoint()
    each = F.array_distinct(F.regexp_extract_all("s", F.lit(f"([^{X.WIN_ANSI}])"), F.lit(1)))
    took = []
    for chars in (X.unencodable(F.col("s")), each) * 3:
        start = time.perf_counter()
        assert {tuple(r.u) for r in long.select(chars.alias("u")).collect()} == {("\u0100",)}
        took.append(time.perf_counter() - start)
    assert min(took[::2]) < 0.6 * min(took[1::2]), took


def test_padded_lines_make_no_cell_of_a_blank(spark):
    ragged = spark.createDataFrame([(1, ["a", None, "c", ""]), (2, ["x"]), (3, []), (4, None), (5, ["", ""])], "r long, cells array<string>")
    want = [(1, ["a", "", "c", ""]), (2, ["x", "", "", ""]), (3, [""] * 4), (4, [""] * 4), (5, [""] * 4)]
    assert rows(S.pad_table(ragged)) == want
    assert rows(S.pad_lines(ragged, "||")) == [(r, "||".join(c)) for r, c in want]
    assert rows(S.pad_table(ragged.filter("r = 3"))) == [(3, [])] and rows(S.pad_lines(ragged.filter("r = 3"), "|")) == [(3, "")]
    plan = catalog.queries()["pad_table"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "array_repeat(" not in plan and "repeat(|" in plan  # the width of the table is no array of each line


def test_one_folding_rule(spark):
    df = spark.createDataFrame([("ma\u017f\u212a",), ("MASK",), ("nix",), (None,)], "s string")
    got = df.select(X.literal_contains(F.col("s"), "mask"), X.literal_count(F.col("s"), "mask"), X.literal_replace(F.col("s"), "mask", "x")).collect()
    assert [tuple(r) for r in got] == [(True, 1, "x"), (True, 1, "x"), (False, 0, "nix"), (None, None, None)]


def test_lines_around_empty_runs(spark, tmp_path):
    cells = spark.createDataFrame([(2, 1, 1, None, "a"), (3, 1, 2, None, "b"), (9, 1, 3, None, "c")], "row long, col int, ord long, num double, str string")
    C.write_csv(cells, str(tmp_path / "out"), run=2)
    text = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "\ufeff\r\na\r\nb" + "\r\n" * 6 + "c\r\n"


def test_sheet_pages_formulas_and_styles(spark):
    kinds = "row int, col int, ref string, ord long, value_type string, num double, str string, formula string, style int, sheet string"
    cells = spark.createDataFrame([(1, 1, "A1", 1, "number", 1.0, None, "B1+1", 3, "s"), (1, 2, "B1", 2, "string", None, "Total", None, 4, "s"), (2, 1, "A2", 3, "string", None, "total", "T(total)", None, "s")], kinds)
    page = C.read_sheet(cells, 0, 2, 5).orderBy("ord").collect()
    assert [(r.ref, r.total, r.truncated) for r in page] == [("A1", 3, True), ("B1", 3, True)]
    with pytest.raises(ValueError):
        C.read_sheet(cells, max_cells=2)
    assert rows(C.count_formulas(cells)) == [("s", 2)] and C.more_than(cells, 2) and not C.more_than(cells, 3)
    edits = spark.createDataFrame([(1, 2, "number", 5.0, None), (3, 1, "number", 6.0, None)], "row int, col int, value_type string, num double, str string")
    assert sorted((r.ref, r.num, r.style, r.formula) for r in C.upsert(cells, edits).filter("num > 1").collect()) == [("A3", 6.0, None, None), ("B1", 5.0, 4, None)]
    plain = search.replace_cells(cells, "total", "SUM").filter("hit").collect()
    assert [(r.ref, r.new) for r in plain] == [("B1", "SUM")]
    with_formulas = search.replace_cells(cells, "total", "SUM", include_formulas=True).filter("hit").orderBy("ord").collect()
    assert [(r.ref, r.new, r.new_formula) for r in with_formulas] == [("B1", "SUM", None), ("A2", "total", "T(SUM)")]
    assert C.chart_categories(cells, "A1:B1").first().categories == ["1", "Total"]


def test_worksheet_rules(spark):
    s = spark.createDataFrame([(0, "One", "visible"), (1, "Two", "hidden")], "pos int, name string, state string")
    assert rows(worksheets.add_sheet(s, "New", 1)) == [(0, "One", "visible"), (1, "New", "visible"), (2, "Two", "hidden")]
    for bad in (lambda: worksheets.add_sheet(s, "ONE"), lambda: worksheets.add_sheet(s, "a/b"), lambda: worksheets.add_sheet(s, "x" * 32), lambda: worksheets.rename_sheet(s, "One", "two"), lambda: worksheets.rename_sheet(s, "Three", "x"), lambda: worksheets.delete_sheet(s, "One")):
        with pytest.raises(ValueError):
            bad()
    assert rows(worksheets.rename_sheet(s, "One", "ONE")) == [(0, "ONE", "visible"), (1, "Two", "hidden")]
    assert rows(worksheets.delete_sheet(worksheets.add_sheet(s, "New"), "One")) == [(0, "Two", "hidden"), (1, "New", "visible")]
    merges = spark.createDataFrame([(1, 1, 2, 2)], "r0 int, c0 int, r1 int, c1 int")
    assert worksheets.merge_range(merges, "C1:D4").count() == 2
    for bad in ("A1:B2", "B2:C3", "F9"):
        with pytest.raises(ValueError):
            worksheets.merge_range(merges, bad)
    assert worksheets.parse_sheet_range("'It''s! 2'!$B$2:A1") == ("It's! 2", (1, 1, 2, 2)) and worksheets.parse_sheet_range("S!C3") == ("S", (3, 3, 3, 3)) and worksheets.parse_sheet_range("A1", "d")[0] == "d"
    codes = spark.createDataFrame([("0.00",), ("x",), ("y",), ("mine",)], "code string")
    assert rows(worksheets.format_ids(codes, spark.createDataFrame([(170, "mine")], "id int, code string"))) == [("0.00", 2), ("mine", 170), ("x", 171), ("y", 172)]


def test_forms_bookmarks_and_rows(spark):
    fields = spark.createDataFrame([("a", "a", "text", None, False), ("b", "b", "choice", ["x"], False), ("c", "c", "button", ["On"], False), ("d", "d", "text", [], True), ("e", "e", "text", [], False)], "name string, field string, type string, options array<string>, read_only boolean")
    values = spark.createDataFrame([("a", "q"), ("b", "y"), ("c", "Off"), ("d", "z")], "name string, new string")
    want = [("a", "q", "filled"), ("b", None, "invalid"), ("c", "Off", "filled"), ("d", None, "read_only"), ("e", None, "unchanged")]
    assert rows(objects.fill_form(fields, values, ["name"]).select("field", "value", "outcome")) == sorted(want, key=str)
    assert objects.fill_form(fields, values, ["name"], force=True).filter("field = 'd'").first().value == "z"
    assert rows(objects.on_states(spark.createDataFrame([("c", ["On", "Off"]), ("c", ["Yes", "On"]), ("n", None)], "field string, states array<string>"))) == [("c", ["On", "Yes"]), ("n", [])]
    marks = spark.createDataFrame([(4, "Here", 0)], "id int, name string, paragraph int")
    assert rows(objects.add_bookmark(marks, 2, "There_1")) == [(4, "Here", 0), (5, "There_1", 2)]
    for bad in ("here", "1st", "a b"):
        with pytest.raises(ValueError):
            objects.add_bookmark(marks, 2, bad)
    t = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (2, 0, 0, "z")], "d long, r int, c int, text string")
    assert rows(S.insert_row(t, ["d"], 0)) == sorted([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, ""), (1, 1, 1, ""), (1, 2, 0, "c"), (2, 0, 0, "z"), (2, 1, 0, "")], key=str)
    assert rows(S.insert_row(t, ["d"], 1).filter("d = 2")) == [(2, 0, 0, "z")]
    assert rows(S.delete_row(t, ["d"], 0)) == [(1, 0, 0, "c"), (2, 0, 0, "z")]
    chars = spark.createDataFrame([("a漢b漢é€",), ("plain",)], "s string").select(X.unencodable(F.col("s")).alias("u")).collect()
    assert [r.u for r in chars] == [["漢"], []]
    tags = spark.createDataFrame([(["r", "hyperlink", "r", "fldChar"],)], "t array<string>")
    assert tags.select(objects.protected_markup(F.col("t"), ["hyperlink", "fldChar", "drawing"])).first()[0] == ["fldChar", "hyperlink"]


def test_references_after_renumbering(spark):
    edges = spark.createDataFrame([(10, 30), (30, 10), (30, 99), (99, 10)], "src long, dst long")
    ids = graph.renumber(spark.createDataFrame([(30,), (10,)], "node long"))
    assert rows(graph.relabel(edges, ids)) == [(1, 2), (2, 1), (2, None)]
    assert rows(graph.referrers(edges, spark.createDataFrame([(10,), (5,)], "node long"))) == [(10, 2, [30, 99]), (5, 0, [])]
    refs = spark.createDataFrame([("dest", 1), ("dest", 2), ("gone", 9)], "holder string, page int")
    assert rows(graph.clean_page_refs(refs, spark.createDataFrame([(1,), (2,)], "page int"))) == [("dest", 1), ("dest", 2)]


def test_plans_that_run_on_tables(spark, tmp_path):
    store = plans.TableStore(spark, str(tmp_path / "t"))
    store.commit(spark.range(10).selectExpr("id", "'v' AS v"))
    book = plans.PlanBook(store)
    p = book.preview("delete_rows", "t", lambda df: df.filter("id < 4"), lambda df: df.filter("id >= 4"))
    assert (p["impact"], p["needs_confirm"], p["status"]) == (4, True, "previewed")
    with pytest.raises(PermissionError):
        book.execute(p["plan_id"])
    assert store.read().count() == 10 and book.execute(p["plan_id"], confirm=True)["status"] == "executed" and store.read().count() == 6
    with pytest.raises(ValueError):
        book.execute(p["plan_id"], confirm=True)
    assert book.rollback(p["plan_id"])["status"] == "rolled_back" and store.read().count() == 10
    q = book.preview("write_cells", "t", lambda df: df.filter("id = 1"), lambda df: df.withColumn("v", F.lit("w")))
    book.execute(q["plan_id"])
    spark.range(3).selectExpr("id", "'x' AS v").write.mode("overwrite").parquet(str(tmp_path / "t" / "v1"))
    with pytest.raises(ValueError):
        book.rollback(q["plan_id"])
    r = book.preview("write_cells", "t", lambda df: df.limit(0), lambda df: df)
    assert book.cancel(r["plan_id"])["status"] == "cancelled" and book.status(r["plan_id"])["impact"] == 0
    with pytest.raises(KeyError):
        book.status("none")


def test_sequence_edits(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "d long, i int, t string")
    assert rows(S.delete_at(p, ["d"], "i", 0)) == [(1, 0, "b"), (2, 0, "c")]
    assert rows(S.move(p.filter("d = 1"), "i", 1, 0)) == [(1, 0, "b"), (1, 1, "a")]
    assert rows(S.pick(p.filter("d = 1"), "i", [1, 1, 0])) == [(1, 0, "b"), (1, 1, "a")]
    with pytest.raises(ValueError):
        S.reorder(p, "i", [0, 0])


def test_checks(spark):
    names = spark.createDataFrame([("ok",), ("a/b",), (None,)], "n string")
    bad = names.filter(~integrity.name_ok(F.col("n"), integrity.SHEET_NAME))
    checks = integrity.checklist({"names": bad, "none": names.limit(0)})
    assert rows(checks) == [("names", False, 2), ("none", True, 0)]
    assert tuple(integrity.valid(checks).first()) == (False, 1)


def test_plans_run_once_and_only_with_consent(spark):
    plan = plans.preview("delete_rows", "s", spark.range(3))
    assert plan.first().needs_confirm
    assert plans.transition(plan, "execute").first().status == "previewed"
    done = plans.transition(plan, "execute", confirm=True)
    assert done.first().status == "executed" and plans.transition(done, "cancel").first().status == "executed"
    assert plans.transition(done, "rollback").first().status == "rolled_back"


def test_table_versions(spark, tmp_path):
    store = plans.TableStore(spark, str(tmp_path / "t"))
    assert store.commit(spark.range(3)) == 1
    assert store.commit(spark.range(5), lambda df: df.count() == 5) == 2
    with pytest.raises(ValueError):
        store.commit(spark.range(1), lambda df: df.count() == 7)
    assert store.read().count() == 5 and store.rollback() == 1 and store.read().count() == 3


def test_audit_log(spark, tmp_path):
    log = lambda e: plans.write_audit(e, str(tmp_path / "log"))
    assert plans.timed(spark, "read", "a", lambda: 1, log)[0] == 1
    with pytest.raises(ZeroDivisionError):
        plans.timed(spark, "read", "b", lambda: 1 // 0, log)
    s = plans.audit_summary(plans.read_audit(spark, str(tmp_path / "log")), F.col("tool"), F.col("ok"), F.col("duration_ms")).first()
    assert (s.tool, s.calls, s.failures) == ("read", 2, 1)


def test_arriving_files_are_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"1")
    for n in (1, 2):
        ingest.ingest_once(ingest.arrivals(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (folder / "b.bin").write_bytes(b"22")
