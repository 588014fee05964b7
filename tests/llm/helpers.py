"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "x" * 200_000), (5, "same words here"), (6, "same words here"), (6, "same words here"), (None, "no id"), (7, "é ß 😀   z")]


def edge(spark, source=True):
    """Edge rows with further columns whose names clash with one another and with what operators make."""
    data = [(i, t, "s" if i and i % 2 else None, 0, "en", "w", 1, 2.0) for i, t in EDGE]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, lang string, TEXT string, id long, score double")


def empty(spark):
    return edge(spark).limit(0).select("doc_id", spark_col(spark, "text"), "source", "n_chars", "lang")


def spark_col(spark, name):
    from pyspark.sql import functions as F

    return F.lit(None).cast("string").alias(name)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
