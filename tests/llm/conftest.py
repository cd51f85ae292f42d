import pytest

TEXTS = [
    (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "   \n\t "),
    (6, "Straße naïve 日本語 text, don't stop!"), (7, "word"), (8, "two words"), (9, "one TWO three four five six"), (9, "one TWO three four five six"), (None, "no id at all"),
]


@pytest.fixture()
def docs(spark):
    """Nulls, empty texts, repeated rows, a null id, and columns that clash with names used inside."""
    rows = [(i, t, "en" if i else None, f"s{i % 3}" if i else None, 1.5, "x", "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, h string, id string".replace("n long", "n double"))


@pytest.fixture()
def nothing(docs):
    return docs.where("false")
