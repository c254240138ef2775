import pytest

HOSTILE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (None, "a row without id", "en"),
    (5, "x", "en"),
    (6, "\x00\t   é́ 🙂 日本語 <|im_end|> \\ ' \" %0A", None),
    (7, "long " * 40_000, "en"),
    (8, "y" * 100_000, "en"),
    (8, "y" * 100_000, "en"),
    (9, "line one\n\nReleased under the MIT License.\nlast line", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and very long texts, ties, a repeated row, and columns whose names clash with ours."""
    rows = [(i, t, lang, "s", 0.5, "m", 7, -1.0) for i, t, lang in HOSTILE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, media string, fp int, base double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
