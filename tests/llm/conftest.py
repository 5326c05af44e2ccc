import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); extra adds columns with names the operators use."""

    def make(*rows, extra=False):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("id", "size", "shard", "kept", "copies", "leaks", "row", "bucket", "h", "g", "p", "source_key", "host", "secrets", "component", "n_words")})
        return df

    return make


@pytest.fixture(scope="session")
def documents(spark, tiny):
    """(doc_id, text) of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


ODD = [(None, "no id at all " * 5), (900, None), (901, ""), (902, " \n\t "), (903, "word"), (904, "word"), (904, "word"), (905, "é" * 120), (906, "x " * 3000), (907, "y" * 20000)]


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty, blank, long and repeated ones."""
    return ODD
