import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size int, row string, `__key` long, text_sha256 string"


def odd_rows():
    """Nulls in any column, empty, long and repeated texts, repeated rows, ties, columns that clash."""
    long_text = " ".join(f"word{i % 977} lorem{i % 13}" for i in range(6000))
    passage = "the quick brown fox jumps over the lazy dog while seventy seven sailors sing songs about the silver sea and more. "
    texts = [
        (1, "Hello world again, hello"), (2, None), (3, ""), (4, long_text), (5, passage + "tail one"), (6, "head two " + passage), (7, passage + "tail one"),
        (8, "Hello world again, hello"), (9, "ha " * 400), (None, "nobody's text"), (None, None), (10, "Ünïcode — 漢字 😀 \t tab\nline\x0bvt\x0cff  two  spaces "), (11, " "), (12, "▁ literal ▁▁ marks"),
        (13, "a"), (13, "b other text of the same id"), (13, "a"), (14, passage.upper()), (15, "x" * 3000), (16, "\x00\x01 nul"),
    ]
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, ["en", "fr", None][i % 3], ["a", "b", "é", None][i % 4], None if t is None else len(t), 0.5, 1, 2, "r", 3, "z"))
    return [*out, out[4], out[4]]  # one row three times


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 17)] + [(None, 1, 1), (3, None, None), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
