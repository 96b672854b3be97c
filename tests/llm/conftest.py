import os

import pytest

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, sources=None):
    """Documents 0, 1, ... with these texts."""
    rows = [(i, t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, sources=None: table(spark, texts, sources)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that operators use themselves."""
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", "en", "a", 3), (4, "word " * 30_000, "en", "b", 150_000),
        (5, "the same five words and more of them", "de", None, 36), (5, "the same five words and more of them", "de", None, 36), (6, "the same five words and more of them", None, "b", 36),
        (None, "a text without an identity that has some words", "fr", "a", 46), (7, "ünïcödé wörds   and more ❤ of thém", "fr", "c", 37),
    ]
    names = ["class", "node", "component", "size", "shard", "first", "label", "score", "words", "start", "bucket", "n_words", "item_id", "at"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], KINDS + ", " + ", ".join(f"`{n}` int" for n in names))
