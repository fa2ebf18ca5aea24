"""File inventory: kinds by their first bytes."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_path(root: str, path: str) -> str:
    """`path` below `root`, both with forward slashes; one that leaves the root, is absolute or has a scheme is refused."""
    if "\0" in path or "://" in path or path.startswith("/") or "\\" in path:
        raise ValueError(f"not a path below the root: {path!r}")
    full = posixpath.normpath(posixpath.join(root, path))
    base = posixpath.normpath(root)
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path!r} leaves the root")
    return full


def sniff(content: Column) -> Column:
    """pdf, zip, ole, html, text-like unknown or empty."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return (
        F.when(F.length(content) == 0, "empty").when(F.startswith(head, F.lit("255044462D")), "pdf").when(F.startswith(head, F.lit("504B")), "zip")
        .when(head == "D0CF11E0A1B11AE1", "ole").when(text.rlike("<!doctype html|<html"), "html").otherwise("unknown")
    )


def list_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, limit: int | None = None, max_depth: int | None = None) -> DataFrame:
    """path, length, modificationTime, ext, depth, total, truncated of files below a folder.

    Names with a leading dot are left out; depth 0 is the folder itself. With a limit the first
    files by path are listed; total counts all and truncated says that some are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    inside = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    files = files.filter(~F.col("path").rlike(r"/\.[^/]*$")).withColumns({"ext": F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1), "depth": F.size(F.split(inside, "/")) - 1})
    if extensions is not None:
        files = files.filter(F.col("ext").isin([e.lower().lstrip(".") for e in extensions]))
    if max_depth is not None:
        files = files.filter(F.col("depth") <= max_depth)
    total = files.agg(F.count(F.lit(1)).alias("total"))  # one row
    listed = files if limit is None else files.orderBy("path").limit(limit)
    return listed.join(F.broadcast(total)).withColumn("truncated", F.lit(False) if limit is None else F.col("total") > limit)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, kind, ext and whether the extension fits the kind. Spark leaves out files without any byte."""
    f = spark.read.format("binaryFile").load(path).withColumn("kind", sniff(F.col("content"))).withColumn("ext", F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1))
    zipped = F.col("ext").isin("xlsx", "xlsm", "docx", "docm", "pptx", "pptm")
    fits = F.when(F.col("kind") == "zip", zipped).when(F.col("kind") == "pdf", F.col("ext") == "pdf").when(F.col("kind") == "html", F.col("ext").isin("html", "htm")).otherwise(F.lit(False))
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "kind", "ext", (~fits).alias("mismatch"))
