"""Shared by the tests."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return "~" if value is None else str(value)


def same_rows(spark_df, relation):
    """Equal column names and, in any order, equal rows."""
    cols = sorted(spark_df.columns)
    assert cols == sorted(relation.columns)
    ours = sorted(tuple(map(normal, r)) for r in spark_df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted(tuple(map(normal, r)) for r in relation.project(quoted).fetchall())
    assert ours == theirs
    return len(ours)
