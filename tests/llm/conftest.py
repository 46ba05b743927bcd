import pytest

LONG = "wide words go on and on " * 8000
#: Names that the operators use inside, as columns of the input.
CLASHING = "CAST(1 AS INT) AS id, 'x' AS th, 'k' AS key, 'l' AS line, 2 AS n, 'z' AS spans, 'q' AS sig, 3 AS comp, 'w' AS items, 0.5D AS score"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) pairs, with the usual columns and some of clashing names."""

    def make(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", *CLASHING.split(", "))

    return make
