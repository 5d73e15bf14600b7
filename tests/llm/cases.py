"""Rows that every operator must take: NULLs, empty and long texts, repeated rows, columns with clashing names."""

from pyspark.sql import types as T

LONG = "la casa de la montaña es muy grande y the river runs der fluss ist " * 4000

ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "   \n\t ", "en", None), (4, "one", None, "s"), (5, "one two", "en", "s"),
    (6, LONG, "es", "s"), (7, "a b c d e f g h i j k l m n o p", "en", "s"), (8, "a b c d e f g h i j k l m n o p", "en", "s"),
    (8, "a b c d e f g h i j k l m n o p", "en", "s"), (None, "lost row without an id", "en", "s"), (9, "!!! ### 123", "de", "s"),
    (10, "x" * 5000, "en", "s"), (11, "ünï\U0001F600   tail\x1c\x85end <|endoftext|> more", "fr", "s"),
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("start", T.StringType()), T.StructField("h", T.StringType()),
    T.StructField("a", T.StringType()), T.StructField("comp", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("measure", T.StringType()), T.StructField("token", T.StringType()), T.StructField("seed", T.StringType())])


def odd(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x" if i != 1 else 7 for i in range(10))) for r in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
