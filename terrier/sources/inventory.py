"""Inventories of documents: how large they are, and whether their text can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters without outer blanks from which a document counts as one with text.
LEAST_TEXT = 100


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, bytes, modified, content) of the files under path. Where content isn't asked for, files are listed and not read. Spark leaves out files of no bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def pages(text: Column) -> Column:
    """Form feeds part pages; a text has one at least, a null text none."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1, F.lit(0)).cast("long")


def inspect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with bytes, pages, chars (of the trimmed text) and text_present added in the place of the text."""
    t = F.col(text)
    chars = F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"^\s+|\s+$", "")).cast("long")
    return docs.select(*[c for c in docs.columns if c != text], F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes"), pages(t).alias("pages"), chars.alias("chars"), (chars >= LEAST_TEXT).alias("text_present"))
