import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """rows of (doc_id, text, lang, source) -> a documents table, with a column that clashes with inner names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("line", T.IntegerType())])

    def make(rows, parts=2):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 7) for r in full], schema).repartition(parts)

    return make
