import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, sha string"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", "same text here now", "same text here now", " \n\t", "one", "One two", "é😀 \x0b x\x1cy", words, words + " more", "Über die Straße geht der Hund und die Katze"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 0, "a", "b") for i, t in enumerate(texts)]
    rows += [rows[2], (None, "same text here now", None, None, None, None, None), (None, None, "de", "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
