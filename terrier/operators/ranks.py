"""Ranks and medians of large groups, from counts per value instead of whole groups in one task.

A group's values are counted first, before and after the shuffle. The counts are dealt to blocks of values that share sign,
power of ten and four leading digits; sums over blocks tell how many rows lie below each block, and running sums stay within
one. A group of any size is so spread over many tasks, and a value that a third of all rows have is one row of counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More than the block of any finite double.
LAST_BLOCK = 10_000_000
#: Digits that a block's values share, and the least power of ten that counts: what is smaller shares blocks with it.
DIGITS, LEAST_POWER = 4, -300


def block(value: Column) -> Column:
    """A number that grows with the value: power of ten and leading digits. NaN comes last, as in Spark's order."""
    size = F.abs(value)
    power = F.greatest(F.floor(F.log10(size)), F.lit(LEAST_POWER))
    of_size = (power + 400) * 10**DIGITS + F.floor(size / F.pow(F.lit(10.0), power) * 10 ** (DIGITS - 1))
    return F.when(F.isnan(value), LAST_BLOCK + 1).when(size == float("inf"), F.signum(value) * LAST_BLOCK).when(value == 0, 0).otherwise(F.signum(value) * of_size).cast("long")


def same(a: DataFrame, b: DataFrame, columns: list[str], other: list[str] | None = None) -> Column:
    """Equality of columns, nulls being equal."""
    return reduce(and_, [a[x].eqNullSafe(b[y]) for x, y in zip(columns, other or columns, strict=True)])


def keyed(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a with the columns that b adds, b having one row for the same `columns`."""
    other = [f"_r{i}" for i in range(len(columns))]
    b = b.withColumnsRenamed(dict(zip(columns, other, strict=True)))
    return a.join(b, same(a, b, columns, other) if columns else F.lit(True), how).drop(*other)


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n: how many rows of the group have the value. Missing values don't count."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def placed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, value, n) with below (rows of smaller values in the group) and total added. Values must not repeat within a group."""
    known = counts.withColumn("_block", block(F.col("value")))
    group = Window.partitionBy(*keys)
    blocks = known.groupBy(*keys, "_block").agg(F.sum("n").alias("_sum"))
    # One row a block: some thousands in a group of any size.
    blocks = blocks.select(*keys, "_block", (F.sum("_sum").over(group.orderBy("_block")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(group).alias("total"))
    within = Window.partitionBy(*keys, "_block").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed(known, blocks, [*keys, "_block"]).withColumn("below", F.col("_before") + F.sum("n").over(within) - F.col("n")).drop("_block", "_before")


def middles(places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, and low and high, the two middle values of each group (the same one in groups of an odd size) of what placed() gives."""
    at = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
    value = F.col("value")
    return places.groupBy(*keys).agg(F.max("total").alias("total"), F.max(F.when(at(F.expr("(total - 1) div 2")), value)).alias("low"), F.max(F.when(at(F.expr("total div 2")), value)).alias("high"))


def half_way(low: Column, high: Column) -> Column:
    return 0.5 * low + 0.5 * high


def by_value(rows: DataFrame, stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the columns that stats (keys, value, ...) adds; rows of values that stats lacks get nulls. A common value is one row of stats, so a hot join key can be split."""
    other = [f"_s{i}" for i in range(len(keys))]
    stats = stats.withColumnsRenamed({**dict(zip(keys, other, strict=True)), "value": "_value"})
    return rows.join(stats, same(rows, stats, keys, other) & rows[value].cast("double").eqNullSafe(stats["_value"]), "left").drop(*other, "_value")
