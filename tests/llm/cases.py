"""Tables that every operator on documents must bear."""

from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("kept", T.StringType()), ("score", T.StringType()))])

EN = "the cat sat on the mat and then it went away to find another warm place near the old stove"
FR = "le chat est assis sur le tapis puis il est parti chercher un autre endroit chaud dans la maison"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z")


def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows and clashing names."""
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, EN), row(5, EN), row(5, EN), row(6, EN + " today"), row(None, FR, None, None), row(7, FR, "fr", None), row(8, "123 ... 456", None, "b"), row(9, "word " * 30_000, "en", "b"), row(10, "x" * 50_000, "en", "c"), row(11, "ünï 中文 🙂 " + FR, "fr", "c")]
    rows += [row(100 + i, f"{EN} {i} and {i * 7}", "en", "a") for i in range(12)]
    rows += [row(200 + i, f"{FR} {i} et {i * 7}", "fr", "b") for i in range(12)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)
