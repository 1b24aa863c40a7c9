"""A small documents table with odd rows, shared by the operator tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])

LONG = "word and other words " * 6000 + "z" * 5000
ODD_TEXTS = [None, "", " \t\n ", "a", "A", "Ä ä ß ſ K İ Σς", "one two three four five six seven",
             "ONE two three four five six SEVEN", "<|endoftext|> a <|startoftext|>b<|endoftext|>",
             "nul \x00 and \x1f and \x85   x", "🙂🙂 é é", LONG, LONG, "'S it's I'LL 12345 ٣٤ ՘"]


def rows():
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    out += [(None, "no id", None, None, None), (None, None, None, None, None), (3, "a", "en", "s", 1), (3, "b", "en", "s", 1)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
