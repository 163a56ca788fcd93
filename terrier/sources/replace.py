"""Replacing one partition of a stored table, so that readers see either the old one or the new one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def replace_partition(df: DataFrame, path: str, column: str, value: str) -> None:
    """Puts df in the place of the partition column=value of the Parquet table at path; others stay untouched.

    df is written beside the table first, so a job that fails changes nothing. Then the old partition is moved aside and
    the new one moved in; should that fail, the old one is moved back. Written again, the table is the same."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    run = uuid.uuid4().hex
    target, staged, aside = at(f"{column}={value}"), at(f"_staged-{run}"), at(f"_old-{run}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.drop(column).write.parquet(staged.toString())
        existed = files.exists(target)
        if existed and not files.rename(target, aside):
            raise OSError(f"{target} can't be moved aside")
        if not files.rename(staged, target):
            if existed:
                files.rename(aside, target)
            raise OSError(f"{staged} can't be moved in")
        files.delete(aside, True)
    finally:
        files.delete(staged, True)
