"""The parcel domain as views over order, part, customer and event tables, for queries, tests and benchmarks. Each view comes with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 250
SIDE = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, township, owner_raw, mail_raw: names made of part names, with companies, towns, the state and nobody among them."""
    c, p, n = (table(spark, sf_dir, t) for t in ("customer", "part", "nation"))
    k = F.col("c_custkey")
    first, second = F.initcap(F.element_at(F.split("p_name", " "), 1)), F.initcap(F.element_at(F.split("p_name", " "), 2))
    raw = (
        F.when(k % 41 == 0, None)
        .when(k % 37 == 0, "Maine State Of")
        .when(k % 31 == 0, F.concat(F.lit("Town Of  "), second))
        .when(k % 11 == 0, F.concat(first, F.lit(" "), second, F.lit(" L.L.C.")))
        .when(k % 5 == 0, F.concat(first, F.lit("s, "), second))
        .otherwise(F.concat(first, F.lit(", "), second))
    )
    mail = F.concat(F.lit("P.O. Box "), (k % 300).cast("string"), F.lit(", "), F.col("n_name"))
    return c.join(p, F.col("p_partkey") == k).join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("custkey"), F.col("n_name").alias("township"), raw.alias("owner_raw"), mail.alias("mail_raw"))


OWNERS_SQL = """owners AS (
    SELECT c_custkey AS custkey, n_name AS township,
        CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'Maine State Of' WHEN c_custkey % 31 = 0 THEN 'Town Of  ' || w2
             WHEN c_custkey % 11 = 0 THEN w1 || ' ' || w2 || ' L.L.C.' WHEN c_custkey % 5 = 0 THEN w1 || 's, ' || w2 ELSE w1 || ', ' || w2 END AS owner_raw,
        'P.O. Box ' || (c_custkey % 300)::VARCHAR || ', ' || n_name AS mail_raw
    FROM customer JOIN (SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || substr(split_part(p_name, ' ', 1), 2) AS w1,
                               upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS w2 FROM part) ON p_partkey = c_custkey
    JOIN nation ON n_nationkey = c_nationkey)"""


def parcels(spark: SparkSession, sf_dir: str, held_by: DataFrame | None = None) -> DataFrame:
    """One parcel an order, its values the sums of its line items as text, unjoined if it has none; laid out on a lattice of squares by order number. held_by: owners() with more columns, which each parcel of an owner gets."""
    cents = lambda flag: F.sum(F.when(flag, F.round(F.col("l_extendedprice") * 100).cast("long")).otherwise(0))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), cents(F.col("l_returnflag") == "A").alias("b"), cents(F.col("l_returnflag") != "A").alias("l"))
    held_by = owners(spark, sf_dir) if held_by is None else held_by
    more = [c for c in held_by.columns if c not in ("custkey", "township", "owner_raw", "mail_raw")]
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(held_by, F.col("o_custkey") == F.col("custkey"))
    k, joined = F.col("o_orderkey"), F.col("l_orderkey").isNotNull()
    urgent, group = F.col("o_orderpriority").startswith("1"), F.floor(k / 3).cast("long")
    return o.select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("parcel_id"),
        k.alias("ordinal"),
        "custkey",
        "township",
        "owner_raw",
        "mail_raw",
        F.when(joined, F.expr("cast(l div 100 as string)")).alias("land_text"),
        F.when(joined, F.expr("cast(b div 100 as string)")).alias("building_text"),
        F.when(joined, F.floor("o_totalprice").cast("long").cast("string")).alias("taxable_text"),
        F.when(joined & urgent, F.when(k % 2 == 0, "25000").otherwise("9,999,999")).alias("exemption_text"),
        F.when(joined, F.expr("cast(quantity as string)")).alias("acres_text"),
        F.when(joined & (group % 10 == 0), "copied_full_assessment").when(joined, "single_lot").alias("allocation"),
        F.concat(F.lit("G"), group.cast("string")).alias("group_id"),
        joined.alias("joined"),
        F.when(joined, "wa_map").otherwise("plat").alias("family"),
        (k % WIDTH).alias("gx"),
        F.floor(k / WIDTH).cast("long").alias("gy"),
        *more,
    )


PARCELS_SQL = (
    OWNERS_SQL
    + f""", items AS (
    SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS quantity,
        sum(CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS b,
        sum(CASE WHEN l_returnflag <> 'A' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS l FROM lineitem GROUP BY 1
), parcels AS (
    SELECT 'P' || lpad(o_orderkey::VARCHAR, 9, '0') AS parcel_id, o_orderkey AS ordinal, custkey, township, owner_raw, mail_raw,
        (l // 100)::VARCHAR AS land_text, (b // 100)::VARCHAR AS building_text,
        CASE WHEN l_orderkey IS NOT NULL THEN floor(o_totalprice)::BIGINT::VARCHAR END AS taxable_text,
        CASE WHEN l_orderkey IS NOT NULL AND o_orderpriority LIKE '1%' THEN CASE WHEN o_orderkey % 2 = 0 THEN '25000' ELSE '9,999,999' END END AS exemption_text,
        quantity::VARCHAR AS acres_text,
        CASE WHEN l_orderkey IS NULL THEN NULL WHEN (o_orderkey // 3) % 10 = 0 THEN 'copied_full_assessment' ELSE 'single_lot' END AS allocation,
        'G' || (o_orderkey // 3)::VARCHAR AS group_id, l_orderkey IS NOT NULL AS joined,
        CASE WHEN l_orderkey IS NOT NULL THEN 'wa_map' ELSE 'plat' END AS family, o_orderkey % {WIDTH} AS gx, o_orderkey // {WIDTH} AS gy
    FROM orders LEFT JOIN items ON o_orderkey = l_orderkey JOIN owners ON o_custkey = custkey
), numbers AS (
    SELECT *, land_text::DOUBLE AS land, building_text::DOUBLE AS building, taxable_text::DOUBLE AS taxable,
        replace(exemption_text, ',', '')::DOUBLE AS exemption, acres_text::DOUBLE AS acres FROM parcels
), features AS (
    SELECT *, land + building AS land_building, taxable - land - building AS taxable_less_parts,
        CASE WHEN lot_level AND acres > 0 THEN taxable / acres END AS taxable_per_acre, CASE WHEN lot_level AND acres > 0 THEN land / acres END AS land_per_acre,
        CASE WHEN lot_level AND acres > 0 THEN building / acres END AS building_per_acre, CASE WHEN land > 0 THEN building / land END AS building_land_ratio,
        coalesce(joined AND building = 0, FALSE) AS vacant, NOT joined AS unjoined,
        CASE WHEN acres < 0 THEN NULL WHEN acres < 2 THEN 'lt2' WHEN acres < 10 THEN '2to10' WHEN acres < 40 THEN '10to40' WHEN acres < 200 THEN '40to200' WHEN acres >= 200 THEN 'ge200' END AS band
    FROM (SELECT *, joined AND coalesce(allocation, '') <> 'copied_full_assessment' AS lot_level FROM numbers)
)"""
)

POOL_SQL = PARCELS_SQL + ", pool AS (SELECT * FROM features WHERE NOT unjoined AND allocation <> 'copied_full_assessment' AND taxable IS NOT NULL)"


def score_sql(source: str, keys: str, metric: str, prefix: str, at_least: int = 12) -> str:
    """A CTE body with what robust_scores() adds."""
    return f"""
        SELECT * EXCLUDE (mid, spread), {metric} - {prefix}_expected AS {prefix}_residual,
            CASE WHEN {prefix}_n >= {at_least} AND {metric} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {metric} NULLS LAST) - 1) / {prefix}_n::DOUBLE END AS {prefix}_percentile,
            CASE WHEN {prefix}_n >= {at_least} AND {metric} IS NOT NULL AND spread > 0 THEN 0.6745 * (ln(1 + greatest(0, {metric})) - mid) / spread END AS {prefix}_mad,
            coalesce({prefix}_n >= {at_least} AND {metric} IS NOT NULL AND spread = 0, FALSE) AS {prefix}_repeated
        FROM (SELECT *, median(abs(ln(1 + greatest(0, {metric})) - mid)) OVER (PARTITION BY {keys}) AS spread
              FROM (SELECT *, count({metric}) OVER (PARTITION BY {keys}) AS {prefix}_n, median({metric}) OVER (PARTITION BY {keys}) AS {prefix}_expected,
                           median(ln(1 + greatest(0, {metric}))) OVER (PARTITION BY {keys}) AS mid FROM {source}))"""


SCORES_SQL = (
    POOL_SQL
    + ", s1 AS (" + score_sql("pool", "township, vacant", "taxable", "town")
    + "), s2 AS (" + score_sql("s1", "township, vacant", "taxable_per_acre", "town_vpa")
    + "), s3 AS (" + score_sql("s2", "township, vacant, band", "taxable", "band")
    + "), scores AS (" + score_sql("s3", "township, vacant, band", "taxable_per_acre", "band_vpa") + ")"
)

#: Scored parcels, those of some owners in places of their own that are too thin for peers, with the nearest 25 of the same occupancy for these.
NEAREST_SQL = (
    POOL_SQL
    + ", outlying AS (SELECT * REPLACE (CASE WHEN custkey % 53 = 0 THEN 'Outlying ' || custkey ELSE township END AS township) FROM pool)"
    + ", s1 AS (" + score_sql("outlying", "township, vacant", "taxable", "town")
    + "), s2 AS (" + score_sql("s1", "township, vacant, band", "taxable", "band")
    + """), near AS (
        SELECT a.parcel_id, a.taxable AS own, b.taxable AS t FROM s2 a JOIN s2 b ON a.parcel_id <> b.parcel_id AND a.vacant = b.vacant
        WHERE a.town_n < 12 AND a.band_n < 12
        QUALIFY row_number() OVER (PARTITION BY a.parcel_id ORDER BY sqrt(power(100.0::DOUBLE * (a.gx - b.gx), 2) + power(100.0::DOUBLE * (a.gy - b.gy), 2)), b.parcel_id) <= 25
    ), mids AS (
        SELECT parcel_id, own, count(*) AS knn_n, median(t) AS knn_expected, own - median(t) AS knn_residual, count(*) FILTER (WHERE t < own) / count(*) AS below, median(ln(1 + greatest(0, t))) AS mid FROM near GROUP BY 1, 2
    ), spreads AS (
        SELECT parcel_id, median(abs(ln(1 + greatest(0, t)) - mid)) AS spread FROM near JOIN mids USING (parcel_id) GROUP BY 1
    ), knn AS (
        SELECT parcel_id, knn_n, knn_expected, knn_residual, CASE WHEN knn_n >= 12 THEN below END AS knn_percentile,
               CASE WHEN knn_n >= 12 AND spread > 0 THEN 0.6745 * (ln(1 + greatest(0, own)) - mid) / spread END AS knn_mad, knn_n >= 12 AND spread = 0 AS knn_repeated
        FROM mids JOIN spreads USING (parcel_id)
    ), scores AS (SELECT * FROM s2 LEFT JOIN knn USING (parcel_id)), best AS (
        SELECT *, CASE WHEN band_n >= 12 THEN 'acreage_band' WHEN town_n >= 12 THEN 'township' WHEN knn_n >= 12 THEN 'knn' END AS peer_kind, """
    + ", ".join(f"CASE WHEN band_n >= 12 THEN band_{f} WHEN town_n >= 12 THEN town_{f} WHEN knn_n >= 12 THEN knn_{f} END AS {f}" for f in ("n", "expected", "residual", "percentile", "mad", "repeated"))
    + " FROM scores)"
)
