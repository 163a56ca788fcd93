"""What the corpus operators share: reading, row keys, pieces of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.sources.scratch import drop_written, written  # noqa: F401

#: A word is a run of anything but space and the five ASCII line and tab characters; bytes.split() cuts at just these six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that begin with those wanted and that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Two columns that name a row in joins: its id (null counts as the smallest long) and a hash of its text. Rows that agree in both are copies of one row, for which every operator here decides alike."""
    return [F.coalesce(id_col.cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64(text).alias("k_text")]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; F.lower() would change other letters, too."""
    return F.translate(text, UPPER, LOWER)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `most` bytes of `column`, so that what numpy makes of a piece stays small; a longer text is a piece of its own."""
    for batch in batches:
        first = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > first and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)
