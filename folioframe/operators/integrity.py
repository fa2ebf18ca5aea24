"""Checks: dangling references, required parts, name rules, and their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules for names.
SHEET_NAME, BOOKMARK_NAME, TABLE_NAME = r"^[^\[\]:*?/\\]{1,31}$", r"^[\p{L}_][\p{L}\p{N}_]{0,39}$", r"^[\p{L}_\\][\p{L}\p{N}_.]*$"


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References without a target; null references are none."""
    return refs.filter(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("__t")), F.col(ref) == F.col("__t"), "left_anti")


def missing_parts(parts: DataFrame, part: str, required: list[str]) -> DataFrame:
    """Required names that `parts` lacks."""
    need = parts.sparkSession.createDataFrame([(r,) for r in required], "part string")
    return need.join(parts.select(F.col(part).alias("__p")).distinct(), F.col("part") == F.col("__p"), "left_anti")


def checklist(checks: dict[str, DataFrame]) -> DataFrame:
    """check, ok, failures: each DataFrame holds the offending rows of its check."""
    rows = [df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("ok"), "failures") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def valid(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("ok").alias("valid"), F.count_if(~F.col("ok")).alias("failed"))


def name_ok(name: Column, rule: str) -> Column:
    return F.coalesce(name.rlike(rule), F.lit(False))


def clashing_names(names: DataFrame, name: str) -> DataFrame:
    """Names met more than once, case aside: name_key, n."""
    return names.groupBy(F.lower(name).alias("name_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
