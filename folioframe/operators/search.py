"""Literal search, and literal replace with change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.exprs import literal_contains, literal_count, literal_pattern, literal_replace, preview


def _check(needle: str, max_results: int = 1, context: int = 0) -> None:
    if not needle:
        raise ValueError("the search text is empty")
    if not 1 <= max_results <= 1000 or not 0 <= context <= 1000:
        raise ValueError("max_results is 1 to 1000, context 0 to 1000")


#: Hits whose places are summed up in one array before the arrays are joined.
RUN = 256


def _places(gaps, hits):
    """Array of (offset, line) of the hits: running sums over the text between them, in runs so that long arrays are not copied for each hit."""
    line_breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), line_breaks(g).alias("gl"), line_breaks(h).alias("hl")))
    place = "array<struct<offset: int, line: int>>"

    def in_run(state, run):
        start = F.struct(state["at"].alias("at"), state["line"].alias("line"), F.array().cast(place).alias("own"))

        def step(a, x):
            offset, line = a["at"] + x["g"], a["line"] + x["gl"]
            return F.struct((offset + x["h"]).alias("at"), (line + x["hl"]).alias("line"), F.array_append(a["own"], F.struct(offset.alias("offset"), line.alias("line"))).alias("own"))

        # bound once by transform, as a lambda's result has no name
        inner = F.array(F.aggregate(F.slice(sizes, run * RUN + 1, F.lit(RUN)), start, step))
        return F.get(F.transform(inner, lambda i: F.struct(i["at"].alias("at"), i["line"].alias("line"), F.array_append(state["runs"], i["own"]).alias("runs"))), F.lit(0))

    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(f"array<{place}>").alias("runs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int"))
    return F.when(F.size(hits) > 0, F.flatten(F.aggregate(runs, begin, in_run)["runs"])).otherwise(F.array().cast(place))


def search(pages: DataFrame, needle: str, match_case: bool = False, max_results: int = 100, context: int = 40) -> DataFrame:
    """Hits of a literal in pages (doc_id, page, text), the first max_results of each document.

    doc_id, page, hit (in the page), offset, line, match, context_before, context_after, and
    total_matches of the document, which the cap does not touch. Offsets and lines are running sums
    over the text between hits; contexts come from that text where it is long enough. Null or empty
    pages have no hits.
    """
    _check(needle, max_results, context)
    pattern = literal_pattern(needle, match_case)
    p = pages.select("doc_id", "page", "text", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("hits"))
    p = p.withColumns({"n": F.size("hits"), "hits": F.slice("hits", F.lit(1), F.lit(max_results))})  # later hits of a page cannot be among the first
    p = p.withColumn("places", F.when(F.col("n") > 0, _places(F.col("gaps"), F.col("hits"))))
    # outer, so that no filter on the arrays is derived and computed below them
    h = p.select("doc_id", "page", "text", "gaps", "hits", "n", F.posexplode_outer("places").alias("hit", "place")).filter(F.col("hit").isNotNull())
    offset, match = F.col("place.offset"), F.get("hits", F.col("hit"))
    before, after = F.get("gaps", F.col("hit")), F.get("gaps", F.col("hit") + 1)
    start, end = F.greatest(offset - context, F.lit(0)), offset + F.length(match)
    enough = lambda gap: F.length(gap) >= context
    h = h.select(
        "doc_id", "page", "hit", offset.alias("offset"), F.col("place.line").alias("line"), match.alias("match"),
        F.when(F.lit(context) == 0, F.lit("")).when(enough(before), F.right(before, F.lit(context))).otherwise(F.substring("text", start + 1, offset - start)).alias("context_before"),
        F.when(enough(after), F.left(after, F.lit(context))).otherwise(F.substring("text", end + 1, F.lit(context))).alias("context_after"), "n",
    )
    per_doc = W.partitionBy("doc_id")
    h = h.withColumns({"total_matches": F.sum(F.when(F.col("hit") == 0, F.col("n"))).over(per_doc).cast("long"), "rn": F.row_number().over(per_doc.orderBy("page", "hit"))})
    return h.filter(F.col("rn") <= max_results).drop("rn", "n")


def search_totals(pages: DataFrame, needle: str, match_case: bool = False, max_results: int = 100) -> DataFrame:
    """Per document: total and returned matches, whether cut, pages and characters scanned."""
    _check(needle, max_results)
    n = literal_count(F.col("text"), needle, match_case)
    t = pages.groupBy("doc_id").agg(F.sum(n).cast("long").alias("total_matches"), F.count(F.lit(1)).alias("pages_scanned"), F.sum(F.length("text")).cast("long").alias("chars_scanned"))
    return t.select("doc_id", "total_matches", F.least("total_matches", F.lit(max_results)).cast("long").alias("returned_matches"), (F.col("total_matches") > max_results).alias("truncated"), "pages_scanned", "chars_scanned")


def search_by_page(pages: DataFrame, needle: str, match_case: bool = False, max_results: int = 100) -> DataFrame:
    """Per document and page: matches, and how many of them are within the document's cap."""
    _check(needle, max_results)
    c = pages.select("doc_id", "page", literal_count(F.col("text"), needle, match_case).cast("long").alias("matches")).filter("matches > 0")
    before = F.coalesce(F.sum("matches").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.select("doc_id", "page", "matches", F.greatest(F.lit(0), F.least("matches", F.lit(max_results) - before)).cast("long").alias("returned_by_page"))


def replace_cells(cells: DataFrame, find: str, replace: str, match_case: bool = False, whole_cell: bool = False, include_formulas: bool = False, max_cells: int | None = None) -> DataFrame:
    """Cells with `new`, the text after replacing in string cells; numbers stay.

    With include_formulas formulas are replaced too, as `new_formula`; cells with a formula are left
    alone without. Over max_cells cells are refused.
    """
    _check(find)
    if max_cells is not None and cells.limit(max_cells + 1).count() > max_cells:
        raise ValueError(f"there are over {max_cells} cells")

    def replaced(s):
        if whole_cell:
            hit = s == find if match_case else s.rlike(rf"\A(?:{literal_pattern(find)})\z")
            return hit, F.when(hit, F.lit(replace)).otherwise(s)
        hit = literal_contains(s, find, match_case)
        return hit, F.when(hit, literal_replace(s, find, replace, match_case)).otherwise(s)

    s = F.col("str")
    plain = F.col("value_type") == "string"
    if "formula" in cells.columns:
        plain = plain & F.col("formula").isNull()
    hit, new = replaced(s)
    out = cells.withColumn("new", F.when(plain, new).otherwise(s)).withColumn("hit", F.coalesce(plain & hit, F.lit(False)))
    if include_formulas:
        formula_hit, formula = replaced(F.col("formula"))
        out = out.withColumn("new_formula", formula).withColumn("hit", F.col("hit") | F.coalesce(formula_hit, F.lit(False)))
    return out


def change_log(replaced: DataFrame, replacement: str) -> DataFrame:
    """Changed cells: ref, from, to (the replacement as given), new_text."""
    return replaced.filter("hit").select("ref", F.col("str").alias("from"), F.lit(replacement).alias("to"), F.col("new").alias("new_text"))


def replace_runs(runs: DataFrame, find: str, replace: str, match_case: bool = False) -> DataFrame:
    """Replacement per text run of a paragraph (doc_id, idx, run, text): counts runs, logs previews.

    spans_runs marks paragraphs whose joined text has the literal where no single run does.
    """
    _check(find)
    hit = literal_contains(F.col("text"), find, match_case)
    r = runs.select("doc_id", "idx", "run", "text", F.when(hit, literal_replace(F.col("text"), find, replace, match_case)).otherwise(F.col("text")).alias("new"), hit.alias("hit"))
    p = r.groupBy("doc_id", "idx").agg(F.sum(F.col("hit").cast("long")).alias("runs_changed"), F.array_sort(F.collect_list(F.struct("run", "text", "new"))).alias("rs"))
    joined = F.array_join(F.transform("rs", lambda x: x["text"]), "")
    out = p.withColumn("spans_runs", literal_contains(joined, find, match_case) & (F.col("runs_changed") == 0))
    return out.filter("runs_changed > 0 OR spans_runs").select("doc_id", "idx", "runs_changed", "spans_runs", preview(joined).alias("before"), preview(F.array_join(F.transform("rs", lambda x: x["new"]), "")).alias("after"))
