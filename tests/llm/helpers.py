"""Plain-Python forms that the operators are held against."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """With columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("score", "key", "rep", "n", "_id", "_y", "words", "label", "print", "stats", "rank", "part", "predicted", "digest"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df
