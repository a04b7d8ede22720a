import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) rows as a table with the columns of documents and some that clash with the operators' own."""

    def make(rows, *, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        if extra:
            for c in ("key", "label", "n", "class", "keys", "rid_a", "h", "b", "score", "ids"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
