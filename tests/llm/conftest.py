import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with the other columns of the table."""
    def make(rows, extra=""):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        for c in extra.split():
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make
