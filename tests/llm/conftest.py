import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Hand-made documents: nulls, empty and long texts, ties, repeated rows, a clashing column."""
    rows = [(1, "a b c", "x"), (2, "ab c", "y"), (3, None, None), (4, "", ""), (5, " \t\n", "z"), (6, "abc ", "w"),
            (6, "abc ", "w"), (7, "Ünïcode ß 漢字", "u"), (8, "word " * 30000, "l"), (9, "word " * 30000 + "end", "l"),
            (None, "a\tbc", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, Kept string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
