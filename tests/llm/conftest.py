import pytest


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    from tallyhouse.llm.queries import with_code

    return with_code(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, one very long text, ties, repeated rows, and extra columns with odd names."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
    one = " ".join(f"alpha{i}" for i in range(50))
    rows = [
        (1, one, "en", "s", 1, "a", 1.0), (1, one, "en", "s", 1, "a", 1.0), (2, one, "en", "s", 1, None, 2.0), (3, None, None, None, None, None, None),
        (4, "", "en", "s", 0, "b", 0.0), (5, " \t\n ", "de", "s", 4, "b", 0.0), (None, "a text without an id in it", "en", "s", 5, "b", 0.0),
        (None, None, None, None, None, None, None), (6, long, "en", "s", 9, "c", 0.0), (7, "12 34 %%% 56", "en", "s", 5, "d", 0.0), (8, "Ünïcödé ▁ 文字 <s> x", "en", "s", 5, "d", 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double")
