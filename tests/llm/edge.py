"""Rows that every operator must survive: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "Lorem ipsum dolor. Sit amet\n" * 6000
ROWS = [(1, "Hello  wörld, it's 2024!", "en", "a", 24), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 4),
        (5, LONG, "en", "a", len(LONG)), (6, "x" * 70000, "en", "a", 70000), (7, "same text here for all of us today", "en", "a", 34),
        (8, "same text here for all of us today", "en", "b", 34), (8, "same text here for all of us today", "en", "b", 34),
        (None, "no id at all but some words here", "en", "a", 32), (9, "é ́x <|endoftext|> mid<|endoftext|>dle    ſs", "fr", "c", 40)]


def edge_docs(spark, *extra):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
