"""Lookups by id, enriched from dimensions with fallbacks. Ids are looked up together: a join with those asked for comes before all others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a geometry comes from if a parcel doesn't say.
GEOMETRY_SOURCE = "state-organized-parcels"


def selected(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows that ids (a column `key`, with or without repeats) name."""
    return rows.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def by_id(rows: DataFrame, ids: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each id asked for that there is: of several rows with one id, the first by ordinal."""
    found = selected(rows, ids, key)
    whole = F.struct(*found.columns)
    return found.groupBy(key).agg(F.min_by(whole, ordinal).alias("row_")).select("row_.*")


def as_of(asked: DataFrame, default: str, *manifests: DataFrame) -> DataFrame:
    """asked (source_id) with `as_of`: the date of the first manifest (source_id, as_of) that tells one, else the default."""
    out, told = asked, []
    for i, m in enumerate(manifests):
        dates = m.groupBy("source_id").agg(F.max("as_of").alias(f"as_of_{i}"))
        out, told = out.join(dates, "source_id", "left"), [*told, f"as_of_{i}"]
    return out.withColumn("as_of", F.coalesce(*told, F.lit(default))).drop(*told)


def _dimension(rows: DataFrame, table: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """rows with the struct of table's row whose `key` is in `column`, null if none is; of equal keys the first by name."""
    fields = [c for c in table.columns if c != key]
    one = table.groupBy(F.col(key).alias(column)).agg(F.min(F.struct(*sorted(fields))).alias("of")).select(column, F.struct(F.col(column).alias("id"), *[F.col(f"of.{c}").alias(c) for c in fields]).alias(out))
    return rows.join(one, column, "left")


def enriched(parcels: DataFrame, municipalities: DataFrame, tax_sources: DataFrame, sources: DataFrame, geometry_source: str = GEOMETRY_SOURCE) -> DataFrame:
    """parcels (municipality_id, tax_municipality_id, source_id, tax_source_id, geometry_source_id) with the names of their municipalities and where tax and geometry come from.

    The tax source is tax_source_id or else source_id, looked up among tax_sources and then sources (both id, name); the
    geometry's has an id in any case, its name if either knows it."""
    names = municipalities.groupBy("id").agg(F.min("name").alias("name"))
    out = parcels
    for c in ("municipality", "tax_municipality"):
        out = out.join(names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name")), f"{c}_id", "left")
    out = out.withColumns({"tax_from": F.coalesce("tax_source_id", "source_id"), "geometry_from": F.coalesce("geometry_source_id", F.lit(geometry_source))})
    for c in ("tax", "geometry"):
        out = _dimension(_dimension(out, tax_sources, f"{c}_from", "id", "first_"), sources, f"{c}_from", "id", "second_")
        unknown = F.struct(F.col("geometry_from").alias("id"), F.lit(None).cast("string").alias("name")) if c == "geometry" else None
        tried: list[Column] = [F.col("first_"), F.col("second_")] + ([unknown] if unknown is not None else [])
        out = out.withColumn(f"{c}_source", F.coalesce(*tried)).drop("first_", "second_")
    return out.drop("tax_from", "geometry_from")


def with_measures(parcels: DataFrame, *measures: DataFrame) -> DataFrame:
    """parcels with what each of measures (parcel_id, ...) tells of them, null where it doesn't; measures have one row a parcel."""
    return reduce(lambda a, b: a.join(b, "parcel_id", "left"), measures, parcels)
