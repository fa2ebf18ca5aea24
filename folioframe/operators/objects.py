"""Edits of document objects: shapes, overlays, form fields, properties, bookmarks, images, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import BOOKMARK_NAME, name_ok


def export_text(documents: DataFrame, lines: int) -> DataFrame:
    """doc_id, text: the pages of `lines` lines, runs of blank lines shortened, trimmed and joined by form feeds."""
    d = documents.select("doc_id", F.split("text", "\n", -1).alias("p"))
    page = lambda i: F.trim(F.regexp_replace(F.array_join(F.slice("p", i * lines + 1, F.lit(lines)), "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / lines).cast("int")), page)
    return d.select("doc_id", F.array_join(pages, "\n\f\n").alias("text"))


def slides_text(slides: DataFrame) -> DataFrame:
    """doc_id, text, slides: texts of the slides (doc_id, page, text) in order, a blank line between."""
    g = slides.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("s"))
    return g.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"), F.size("s").cast("long").alias("slides"))


def set_shape_text(shapes: DataFrame, keys: list[str], hit: Column, text: str) -> DataFrame:
    """keys, paragraph, text: the shapes' texts by paragraph, that of the shapes in `hit` replaced."""
    new = F.when(hit, F.lit(text)).otherwise(F.col("text"))
    return shapes.select(*keys, F.posexplode(F.split(new, "\n", -1)).alias("paragraph", "text"))


def assign_by_name(items: DataFrame, name: Column, known: DataFrame, known_name: str, known_id: str, out: str) -> DataFrame:
    """items with `out`: the id of the layout or theme of that name, case aside; of equal names the first. Unknown names drop out."""
    first = known.groupBy(F.lower(known_name).alias("__name")).agg(F.min(known_id).alias(out))
    return items.join(first, F.lower(name) == F.col("__name")).drop("__name")


def overlay(pages: DataFrame, text: str, chosen: Column) -> DataFrame:
    """doc_id, page, overlay: a text on the chosen pages."""
    if not text:
        raise ValueError("the overlay has no text")
    return pages.filter(chosen).select("doc_id", "page", F.lit(text).alias("overlay"))


def chart_points(rows: DataFrame, label: str, series: str, value: str) -> DataFrame:
    """label, series, value: one number for each label and series that occurs; what is no finite number counts as 0."""
    v = F.col(value).cast("double")
    number = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    return rows.groupBy(F.col(label).alias("label"), F.col(series).alias("series")).agg(F.sum(number).alias("value"))


def losses(slides: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """One row: how many slides carry each mark that an export would lose, and all slides."""
    return slides.agg(*[F.count_if(c).alias(k) for k, c in marks.items()], F.count(F.lit(1)).alias("slides"))


def fill_form(fields: DataFrame, values: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """fields (keys, field, type, options, read_only) x values (keys, new) -> keys, field, value, outcome.

    Texts take any value; choices and buttons one of their options (a button also Off). Read-only
    fields refuse unless forced. outcome: unchanged, read_only, filled, invalid.
    """
    j = fields.join(values.select(*keys, "new"), keys, "left")
    new, options = F.col("new"), F.coalesce("options", F.array().cast("array<string>"))
    allowed = (F.col("type") == "text") | F.array_contains(options, new) | ((F.col("type") == "button") & (new == "Off"))
    closed = F.col("read_only") & F.lit(not force)
    outcome = F.when(new.isNull(), "unchanged").when(closed, "read_only").when(allowed, "filled").otherwise("invalid")
    return j.withColumn("outcome", outcome).select(*keys, "field", F.when(F.col("outcome") == "filled", new).alias("value"), "outcome")


def on_states(widgets: DataFrame) -> DataFrame:
    """field, options: the distinct states that a button's widgets (field, states array) can show, Off aside, in order."""
    each = widgets.select("field", F.explode_outer("states").alias("s"))
    return each.groupBy("field").agg(F.sort_array(F.collect_set(F.when(F.col("s") != "Off", F.col("s")))).alias("options"))


def set_properties(properties: DataFrame, changes: DataFrame) -> DataFrame:
    """properties (key, value) and changes (key, new) -> key, from, to; a null change leaves the value."""
    have, put = properties.select("key", F.col("value").alias("from")), changes.select("key", "new")
    return have.join(put, "key", "full_outer").select("key", "from", F.coalesce("new", "from").alias("to"))


def add_bookmark(bookmarks: DataFrame, paragraph: int, name: str) -> DataFrame:
    """bookmarks (id, name, paragraph) with one more: id the largest plus one; the name obeys the rule and is new, case aside."""
    if bookmarks.sparkSession.range(1).filter(name_ok(F.lit(name), BOOKMARK_NAME)).isEmpty():
        raise ValueError(f"not a bookmark name: {name!r}")
    if not bookmarks.filter(F.lower("name") == name.lower()).isEmpty():
        raise ValueError(f"a bookmark is called {name!r} already")
    kinds = dict(bookmarks.dtypes)
    new = bookmarks.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast(kinds["id"]).alias("id"))
    return bookmarks.select("id", "name", "paragraph").unionByName(new.select("id", F.lit(name).alias("name"), F.lit(paragraph).cast(kinds["paragraph"]).alias("paragraph")))


def image_uses(uses: DataFrame, key: str, page: str) -> DataFrame:
    """object_key, pages (joined by commas, in order), n_pages: each image once, with the pages that draw it."""
    g = uses.groupBy(F.col(key).alias("object_key")).agg(F.sort_array(F.collect_set(page)).alias("p"))
    return g.select("object_key", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"), F.size("p").cast("long").alias("n_pages"))


def protected_markup(tags: Column, protected: list[str]) -> Column:
    """The distinct protected tags among a paragraph's tags, in order."""
    return F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, protected))))
