import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows and extra columns with clashing names."""
    long_text = "The quick word of it and the other one stands here. " * 4000
    rows = [
        (1, "The cat sat on the mat and the dog of the house saw it all.\nSecond line of five words here.", "en", "a", 1),
        (1, "The cat sat on the mat and the dog of the house saw it all.\nSecond line of five words here.", "en", "a", 1),
        (2, "The cat sat on the mat and the dog of the house saw it all.\nSecond line of five words here.", None, "a", 1),
        (3, None, "en", None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t\n  ", "en", "b", 7),
        (None, "No id but a text with mail a.b@c.example.com and more words.", "de", "b", 3),
        (None, None, None, None, None),
        (6, long_text, "en", "c", len(long_text)),
        (7, "x" * 50_000, "fr", "c", 50_000),
        (8, "Ünïcödé 日本語 😀 text with +1 (487) 555-7209 and 4111 1111 1111 1111.", "fr", "c", 70),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that operators use inside
    return docs.selectExpr("*", "'k' AS key", "'w' AS words", "1 AS row", "'t' AS line", "2 AS score", "DATE '2020-01-01' AS bucket")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")

