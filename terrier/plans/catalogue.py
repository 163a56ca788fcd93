"""All registered queries of the parcel engine, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrier.plans import codes, linkage, lookups, owners, places, scoring, shapes, shown, texts

_PARTS = (scoring, places, owners, linkage, texts, codes, shapes, lookups, shown)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcels that stand highest above their peers."""
    return QUERIES["valuation_catalogue_high"](spark, sf_dir)
