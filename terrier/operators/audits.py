"""Checks on finished tables: counts against what was published, parents of joined lots, and batches that must not go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_parity(published: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """published (key, published): key, published, counted, delta and ok for each key of either table. Published counts that are missing are not held against a table."""
    counted = rows.groupBy(key).agg(F.count("*").alias("counted"))
    both = published.select(key, "published").join(counted, key, "full").withColumn("counted", F.coalesce("counted", F.lit(0)))
    delta = F.abs(F.col("published") - F.col("counted"))
    return both.select(key, "published", "counted", delta.alias("delta"), F.coalesce(delta == 0, F.lit(True)).alias("ok"))


def parent_joins(joined: DataFrame, suspicious: Column) -> DataFrame:
    """joined (township, method): by township, how many lots were joined, how many to a parent, and how many of those are suspicious."""
    parent = F.col("method") == "map_lot_parent"
    return joined.groupBy("township").agg(F.count_if(F.col("method") != "unjoined").alias("joined"), F.count_if(parent).alias("parents"), F.count_if(parent & F.coalesce(suspicious, F.lit(False))).alias("suspicious"))


def required(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """rows, which fail the job as they are read if `holds` isn't true of one of them."""
    return rows.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
