import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def documents_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark, documents_schema):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    en = "the cat and the dog ran with the bird over the hill and then the sun was out"
    rows = [
        (1, en, "en", "a", 80), (1, en, "en", "a", 80), (2, en + " again", "en", None, 1), (3, None, "en", "a", None),
        (4, "", None, "b", 0), (None, en, "en", "a", 5), (5, "der hund und die katze sind nicht mit dem vogel", "de", "b", 4),
        (6, " \t\n ", "de", "b", 3), (7, "123 456 !!", "de", "c", 3), (8, "the idiot " * 3000, "en", "a", 30000), (9, "x" * 50000, None, "a", 1),
    ]
    return spark.createDataFrame([Row(*r) for r in rows], documents_schema)


@pytest.fixture(scope="session")
def no_documents(spark, documents_schema):
    return spark.createDataFrame([], documents_schema)
