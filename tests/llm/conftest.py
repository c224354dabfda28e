import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that operators make themselves, with other contents.
CLASHES = ("size", "key", "shard", "mark", "copies", "rate", "target", "score", "leaks", "place",
           "host", "root", "tid", "_n", "label")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clash=False):
        full = [(i, text, "en", source, 0) for i, text, source in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in CLASHES:
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty and long texts, repeated rows, null ids and sources."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (None, "two words", "b"),
            (5, long, "b"), (6, long + " end", "b"), (7, " \t\n ", "c"), (8, "Ünï cödé 漢字 🎉 text", "é"),
            (9, "x" * 50_000, "c"), (None, None, None)]
    return docs_of(rows, clash=True)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
