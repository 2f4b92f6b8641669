import pytest

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty and repeated rows, null ids, ties, a very long text, and columns
    whose names the operators use themselves."""
    para = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    line = "one line of text\nanother line of text\na third line of text\n"
    rows = [
        (1, para, "en"), (2, para, "en"), (3, None, "en"), (4, "", None), (5, " \n ", "de"), (5, " \n ", "de"), (None, para, "en"), (None, None, None),
        (6, line + "tail six", "en"), (7, line + "tail seven", "en"), (8, "x" * 300_000, "en"), (9, "token = \"0123456789abcdef0123\" end", "fr"), (10, "a", "fr"), (11, "12345 67", "fr"),
    ]
    wide = [(i, t, g, "s", len(t or ""), 1, 2, "k", "v", 0) for i, t, g in rows]
    return spark.createDataFrame(wide, DDL + ", id long, size int, key string, label string, lines int").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
