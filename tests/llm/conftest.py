import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, lang, source]) tuples -> a documents table in two partitions, with columns whose names clash with results."""

    def make(rows, clash=("size", "node", "kept", "bucket", "range", "start", "score")):
        full = [(r[0], r[1], *(list(r[2:]) + [None] * 2)[:2], len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(2)
        for c in clash:
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "no id at all"), (5, "same words here"), (5, "same words here"), (6, "Ünïcödé 文字 😀 ok"), (7, "word " * 30_000), (8, "x" * 100_000)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
