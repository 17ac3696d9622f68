"""Small inputs with the awkward cases that every operator must take."""
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("ids", T.StringType()),
    T.StructField("decoded", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("n_tokens", T.StringType()), T.StructField("key", T.StringType()),
])


def docs(spark, texts, langs=None, first=0):
    """Documents with extra columns whose names clash with results."""
    rows = [(first + i, t, langs[i] if langs else "en", "s", len(t or ""), "x", "y", None, "z", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
