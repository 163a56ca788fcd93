"""Queries on lookups, write-backs, manifests and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.operators import linkage, lookup, serving
from terrier.plans.places import shapes
from terrier.plans.registry import Registry
from terrier.plans.scoring import _FLAGS, _PERCENT, _percents
from terrier.plans.texts import _PLACES_SQL, _places
from terrier.plans.views import PARCELS_SQL, parcels, table
from terrier.sources import inventory

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _s(c):
    return c.cast("string")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions as tax sources, nations as all others; the two share an id."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.select(F.concat(F.lit("src-"), _s(F.col("r_regionkey"))).alias("id"), F.col("r_name").alias("name")), n.select(F.concat(F.lit("src-"), _s(F.col("n_nationkey") + 4)).alias("id"), F.col("n_name").alias("name"))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with the ids of municipalities and sources that some rows lack and some dimensions don't know."""
    k = F.col("ordinal")
    return parcels(spark, sf_dir).select(
        "parcel_id", "ordinal", F.col("township").alias("municipality_id"), F.concat(F.lit("NATION_"), _s(F.col("custkey") % 30)).alias("tax_municipality_id"),
        F.when(k % 4 < 2, F.concat(F.lit("src-"), _s(k % 9))).when(k % 4 == 2, "nowhere").alias("source_id"), F.when(k % 3 == 0, F.concat(F.lit("src-"), _s(k % 40))).alias("tax_source_id"), F.when(k % 5 != 0, F.concat(F.lit("src-"), _s(k % 35))).alias("geometry_source_id"),
    )


@_r.query(f"""
    WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT}, asked AS (SELECT DISTINCT 'P' || lpad((user_id * 3)::VARCHAR, 9, '0') AS parcel_id FROM events WHERE event_id % 5 = 0
    ), filed AS (
        SELECT parcel_id, township, custkey, gx, gy, CASE WHEN ordinal % 4 < 2 THEN 'src-' || ordinal % 9 WHEN ordinal % 4 = 2 THEN 'nowhere' END AS source_id, CASE WHEN ordinal % 3 = 0 THEN 'src-' || ordinal % 40 END AS tax_source_id,
               CASE WHEN ordinal % 5 <> 0 THEN 'src-' || ordinal % 35 ELSE 'state-organized-parcels' END AS geometry_from
        FROM parcels JOIN asked USING (parcel_id)
    ), every AS (
        SELECT 'src-' || r_regionkey AS id, r_name AS name, 1 AS turn FROM region UNION ALL SELECT 'src-' || (n_nationkey + 4), n_name, 2 FROM nation
    ), known AS (SELECT id, arg_min(name, turn) AS name FROM every GROUP BY 1)
    SELECT f.parcel_id, f.township AS municipality_name, t.n_name AS tax_municipality_name, x.id AS tax_source, x.name AS tax_source_name, f.geometry_from AS geometry_source, g.name AS geometry_source_name,
        round(10000 / 4046.8564224, 6) AS acres, (f.gx * 100)::DOUBLE AS west, (f.gy * 100 + 100)::DOUBLE AS north, (f.gx * 100 + 50)::DOUBLE AS x, p.percent
    FROM filed f LEFT JOIN nation t ON t.n_name = 'NATION_' || f.custkey % 30 LEFT JOIN known x ON x.id = coalesce(f.tax_source_id, f.source_id) LEFT JOIN known g ON g.id = f.geometry_from LEFT JOIN percents p ON p.parcel_id = f.parcel_id""")
def parcel_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcels that events ask for, some of which there aren't, with municipalities, sources, acres, box, place and rank."""
    asked = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.concat(F.lit("P"), F.lpad(_s(F.col("user_id") * 3), 9, "0")).alias("parcel_id"))
    found = lookup.by_id(_filed(spark, sf_dir), asked, "parcel_id", "ordinal")
    towns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"))
    told = lookup.enriched(found, towns, *_sources(spark, sf_dir))
    parts = F.array(F.array("ring"))
    shown = lookup.selected(shapes(spark, sf_dir).withColumnRenamed("id", "parcel_id"), asked, "parcel_id").select("parcel_id", geo.to_acres(geo.shape_area(parts)).alias("acres"), geo.shape_box(parts).alias("box"), geo.shape_point(parts).alias("point"))
    out = lookup.with_measures(told, shown, lookup.selected(_percents(spark, sf_dir).select("parcel_id", "percent"), asked, "parcel_id"))
    return out.select(
        "parcel_id", "municipality_name", "tax_municipality_name", F.col("tax_source.id").alias("tax_source"), F.col("tax_source.name").alias("tax_source_name"), F.col("geometry_source.id").alias("geometry_source"), F.col("geometry_source.name").alias("geometry_source_name"),
        F.round("acres", 6).alias("acres"), "box.west", "box.north", "point.x", "percent",
    )


@_r.query("""
    WITH a AS (SELECT 's' || s_suppkey AS source_id, s_suppkey AS k FROM supplier)
    SELECT source_id, CASE WHEN k % 3 = 0 THEN '2024-0' || (k % 9 + 1) || '-01' WHEN k % 2 = 0 THEN '2023-01-01' ELSE '1970-01-01' END AS as_of FROM a""")
def source_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of suppliers as sources: a third from a first manifest, half of the rest from a second, else the default."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit("s"), _s(k)).alias("source_id"))
    first = s.where(k % 3 != 1).select("source_id", F.when(k % 3 == 0, F.concat(F.lit("2024-0"), _s(k % 9 + 1), F.lit("-01"))).alias("as_of"))
    second = s.where(k % 2 == 0).select("source_id", F.lit("2023-01-01").alias("as_of"))
    return lookup.as_of(s.select("source_id"), "1970-01-01", first, second)


@_r.query("""
    SELECT p_partkey AS tax_id, m.geometry_id FROM part LEFT JOIN (
        SELECT l_partkey, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS geometry_id FROM lineitem WHERE l_linenumber > 1 GROUP BY 1
    ) m ON m.l_partkey = p_partkey""")
def write_back_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all orders that hold a part beyond their first line, the last is the part's."""
    matches = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_partkey").alias("tax_id"), F.col("l_orderkey").alias("geometry_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return linkage.write_back(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tax_id"), F.lit(None).cast("long").alias("geometry_id")), matches)


@_r.query("""
    SELECT n_nationkey AS batch, 'kept' AS note, coalesce(c.rows_, -1) AS records, coalesce(c.joined, -1) AS joined FROM nation LEFT JOIN (
        SELECT c_nationkey, count(*) AS rows_, count(*) FILTER (WHERE c_acctbal > 0) AS joined FROM customer WHERE c_nationkey <> 7 GROUP BY 1) c ON c.c_nationkey = n_nationkey""")
def batch_stats_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of batches replaced by what customers say; one batch has none and keeps its own."""
    stats = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch"), F.lit("kept").alias("note"), F.lit(-1).cast("long").alias("records"), F.lit(-1).cast("long").alias("joined"))
    rows = table(spark, sf_dir, "customer").where("c_nationkey != 7").withColumnRenamed("c_nationkey", "batch")
    return linkage.patch_stats(stats, rows, "batch", records=F.count("*"), joined=F.count_if(F.col("c_acctbal") > 0))


@_r.query(f"""
    WITH {PARCELS_SQL}, t AS (SELECT township, owner_raw IS NOT NULL AS owner, coalesce(taxable BETWEEN 100 AND 50000000, FALSE) AS assessed, joined FROM features)
    SELECT coalesce(township, '*') AS township, count(*) AS n, count(*) FILTER (WHERE owner) AS owner, count(*) FILTER (WHERE assessed) AS assessed, count(*) FILTER (WHERE owner AND assessed) AS quality, count(*) FILTER (WHERE joined AND NOT owner) AS dirty,
        round(count(*) FILTER (WHERE owner) / count(*), 6) AS owner_rate, round(count(*) FILTER (WHERE assessed) / count(*), 6) AS assessed_rate, round(count(*) FILTER (WHERE owner AND assessed) / count(*), 6) AS quality_rate, round(count(*) FILTER (WHERE joined AND NOT owner) / count(*), 6) AS dirty_rate
    FROM t GROUP BY ROLLUP (township)""")
def coverage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of owners, assessments, both, and records without an owner, by township and of all."""
    owner, assessed = F.col("owner_raw").isNotNull(), F.coalesce(F.col("taxable_text").cast("double").between(100, 50_000_000), F.lit(False))
    return linkage.coverage_manifest(parcels(spark, sf_dir), "township", owner=owner, assessed=assessed, quality=owner & assessed, dirty=F.col("joined") & ~owner)


@_r.query(r"""
    WITH d AS (SELECT doc_id, text, length(regexp_replace(coalesce(text, ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')) AS chars FROM documents)
    SELECT doc_id, coalesce(strlen(text), 0) AS bytes, coalesce(length(text) - length(replace(text, chr(12), '')) + 1, 0) AS pages, chars, chars >= 100 AS text_present FROM d""")
def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inspect(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_r.query(f"""
    WITH {_PLACES_SQL}, home AS (SELECT places.*, 'r' || coalesce(n_regionkey, r_regionkey) AS municipality_id FROM places LEFT JOIN nation ON id = 'n' || n_nationkey LEFT JOIN region ON id = 'r' || r_regionkey)
    SELECT m AS municipality_id, id, name, CASE WHEN key = 'a' THEN 100 WHEN starts_with(key, 'na') THEN 80 ELSE 50 END + rank AS score FROM home JOIN (SELECT unnest(['r1', 'r2']) AS m) f ON f.m = municipality_id WHERE contains(key, 'na')""")
def search_places_of_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in two municipalities."""
    places = _places(spark, sf_dir)
    each = [serving.search_places(places, "na", municipality=m).select(F.lit(m).alias("municipality_id"), "id", "name", "score") for m in ("r1", "r2")]
    return each[0].unionByName(each[1])
