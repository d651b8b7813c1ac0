import re

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


#: Nulls, empty and blank texts, ties, repeated rows, one very long text, a missing doc_id, other scripts.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "one two three four five six", None),
    (6, "Ünï çödé   wörds\nÜnï çödé", "b"), (7, "word " * 30000, "c"), (None, "no id here at all", "c"), (9, "x" * 50000, None),
]
SCHEMA = "doc_id long, text string, source string"


def odd(spark):
    """Documents that are hard in one way each, with a column whose name could clash."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumn("length", F.lit("extra")).withColumn("size", F.lit("extra"))
