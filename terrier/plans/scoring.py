"""Queries on features, peers, percentiles, flags and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import owners as own
from terrier.functions import values as v
from terrier.operators import peers, serving
from terrier.plans.registry import Registry
from terrier.plans.views import NEAREST_SQL, PARCELS_SQL, POOL_SQL, SCORES_SQL, SIDE, parcels

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
_NUMBERS = ("land", "building", "taxable", "exemption", "acres", "land_building", "taxable_less_parts", "taxable_per_acre", "land_per_acre", "building_per_acre", "building_land_ratio")


def features(spark: SparkSession, sf_dir: str, held_by: DataFrame | None = None) -> DataFrame:
    return peers.build_features(parcels(spark, sf_dir, held_by))


def scores(spark: SparkSession, sf_dir: str, *prefixes: str, spread: bool = True) -> DataFrame:
    return scores_of(features(spark, sf_dir), *prefixes, spread=spread)


def scores_of(rows: DataFrame, *prefixes: str, spread: bool = True, held: bool = False) -> DataFrame:
    needed = rows.select("parcel_id", "custkey", "township", "band", "vacant", "unjoined", "allocation", "taxable", "taxable_per_acre")
    return peers.peer_scores(needed, prefixes or tuple(peers.METRICS), spread, held)


@_r.query(f"WITH {PARCELS_SQL} SELECT parcel_id, {', '.join(_NUMBERS)}, vacant, unjoined, allocation, group_id FROM features")
def parcel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("parcel_id", *_NUMBERS, "vacant", "unjoined", "allocation", "group_id")


@_r.query(f"""WITH {PARCELS_SQL} SELECT parcel_id, band, CASE band WHEN 'lt2' THEN '<2 ac' WHEN '2to10' THEN '2–10 ac' WHEN '10to40' THEN '10–40 ac' WHEN '40to200' THEN '40–200 ac' WHEN 'ge200' THEN '≥200 ac' END AS label,
    coalesce(abs(acres - (acres * 1.08 + 0.3)) > greatest(0.5, abs(acres * 1.08 + 0.3) * 0.1), FALSE) AS disagree FROM features""")
def acreage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("parcel_id", "band", v.band_label(F.col("band")).alias("label"), v.acres_disagree(F.col("acres"), F.col("acres") * 1.08 + 0.3).alias("disagree"))


def _scores_of(prefixes: tuple[str, ...]) -> list[str]:
    return [f"{p}_{f}" for p in prefixes for f in ("n", "expected", "residual", "percentile", "mad", "repeated")]


@_r.query(f"WITH {SCORES_SQL} SELECT parcel_id, {', '.join(_scores_of(('town', 'town_vpa')))} FROM scores")
def peer_scores_township(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "town", "town_vpa").select("parcel_id", *_scores_of(("town", "town_vpa")))


@_r.query(f"WITH {SCORES_SQL} SELECT parcel_id, {', '.join(_scores_of(('band', 'band_vpa')))} FROM scores")
def peer_scores_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "band", "band_vpa").select("parcel_id", *_scores_of(("band", "band_vpa")))


@_r.query(f"WITH {PARCELS_SQL} SELECT CASE WHEN unjoined THEN 'unjoined' WHEN allocation = 'copied_full_assessment' THEN allocation WHEN taxable IS NULL THEN 'no_taxable_value' ELSE 'scored' END AS reason, count(*) AS n FROM features GROUP BY 1")
def peer_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(F.coalesce(peers.skip_reason(), F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"))


def _nearest_scores(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    """Scores against band, township or the nearest; the parcels of one owner in 53 lie in places of their own, which are too thin."""
    place = F.when(F.col("custkey") % 53 == 0, F.concat(F.lit("Outlying "), F.col("custkey").cast("string"))).otherwise(F.col("township"))
    needed = features(spark, sf_dir).select("parcel_id", place.alias("township"), "band", "vacant", "unjoined", "allocation", "taxable", "taxable_per_acre", (F.col("gx") * SIDE).alias("x"), (F.col("gy") * SIDE).alias("y"))
    return peers.with_nearest(peers.peer_scores(needed, ("town", "band"), spread))


def _catalogue_sql(order: str) -> str:
    return f"WITH {NEAREST_SQL} SELECT parcel_id, township, vacant, taxable AS observed, expected, residual, percentile, peer_kind, n AS peer_n FROM best WHERE residual IS NOT NULL ORDER BY residual {order}, parcel_id LIMIT 25"


@_r.query(_catalogue_sql("DESC"))
def valuation_catalogue_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.catalogue(_nearest_scores(spark, sf_dir, spread=False), highest=True)


@_r.query(_catalogue_sql("ASC"))
def valuation_catalogue_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.catalogue(_nearest_scores(spark, sf_dir, spread=False), highest=False)


@_r.query(f"WITH {NEAREST_SQL} SELECT parcel_id, knn_n, knn_expected, knn_residual, knn_percentile, round(knn_mad, 7) AS knn_mad, knn_repeated FROM scores WHERE knn_n IS NOT NULL")
def thin_places_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels whose band and township are too thin, against their 25 nearest."""
    return _nearest_scores(spark, sf_dir, spread=False).where("knn_n is not null").select("parcel_id", "knn_n", "knn_expected", "knn_residual", "knn_percentile", F.round("knn_mad", 7).alias("knn_mad"), "knn_repeated")


@_r.query(f"""
    WITH {NEAREST_SQL}
    SELECT parcel_id, CASE WHEN peer_kind IS NOT NULL THEN
        'Parcel ' || parcel_id || ' taxable value is $' || format('{{:,}}', floor(taxable + 0.5)::BIGINT) || '. Expected (median of ' || n || CASE WHEN vacant THEN ' vacant' ELSE ' improved' END || ' parcels in ' || township
        || CASE peer_kind WHEN 'acreage_band' THEN ' acreage band ' || CASE band WHEN 'lt2' THEN '<2 ac' WHEN '2to10' THEN '2–10 ac' WHEN '10to40' THEN '10–40 ac' WHEN '40to200' THEN '40–200 ac' ELSE '≥200 ac' END
                          WHEN 'knn' THEN ' (k-nearest comparable parcels)' ELSE '' END
        || ') is $' || format('{{:,}}', floor(expected + 0.5)::BIGINT) || '. Residual $' || format('{{:,}}', floor(residual + 0.5)::BIGINT) || '. Peer percentile ' || coalesce(printf('%.1f', floor(percentile * 1000 + 0.5) / 10), 'n/a')
        || '. MAD(log taxable) ' || CASE WHEN repeated THEN 'repeated-value class (MAD=0)' ELSE coalesce(printf('%.2f', floor(mad * 100 + 0.5) / 100), 'n/a') END
        || '. This is a comparison to an appropriate peer group, not a finding of error or wrongdoing.' END AS explanation
    FROM best""")
def residual_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.explain(_nearest_scores(spark, sf_dir, spread=True))


_FLAGS = """flags AS (
    SELECT parcel_id, taxable_text, acres_text, taxable, acres, exemption,
        CASE WHEN building IS NULL THEN -1 WHEN building = 0 THEN 0 ELSE 1 END AS cohort,
        coalesce(taxable > 0 AND exemption >= taxable, FALSE) OR coalesce(taxable IS NULL AND exemption > 0 AND coalesce(land, 0) + coalesce(building, 0) > 0 AND exemption >= coalesce(land, 0) + coalesce(building, 0), FALSE) AS exempt,
        coalesce(exemption IN (25000, 31000), FALSE) AS homestead,
        taxable BETWEEN 100 AND 50000000 AS money
    FROM features)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return parcels(spark, sf_dir).select(
        "parcel_id",
        "owner_raw",
        "taxable_text",
        "acres_text",
        v.building_cohort(c("building_text")).alias("cohort"),
        v.fully_exempt(c("exemption_text"), c("taxable_text"), c("land_text"), c("building_text")).alias("exempt"),
        v.homestead(c("exemption_text"), F.lit(None).cast("boolean")).alias("homestead"),
    )


@_r.query(f"WITH {PARCELS_SQL}, {_FLAGS} SELECT parcel_id, cohort, exempt, homestead FROM flags")
def exempt_homestead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("parcel_id", "cohort", "exempt", "homestead")


_PERCENT = """ranked AS (
    SELECT *, CASE WHEN cohort >= 0 AND NOT exempt AND money AND acres > 0 THEN taxable / acres END AS vpa FROM flags
), placed AS (
    SELECT *, count(vpa) OVER (PARTITION BY cohort) AS n, rank() OVER (PARTITION BY cohort ORDER BY vpa NULLS LAST) + (count(*) OVER (PARTITION BY cohort, vpa) - 1) / 2.0 AS place FROM ranked
), percents AS (
    SELECT *, CASE WHEN vpa IS NULL THEN -1 WHEN n = 1 THEN 50 ELSE floor(100 * (place - 1) / (n - 1) + 0.5) END::INT AS percent FROM placed)"""


def _percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).withColumn("vpa", F.when((F.col("cohort") >= 0) & ~F.col("exempt"), v.value_per_acre(F.col("taxable_text"), F.col("acres_text"))))
    return peers.average_rank_percent(rows, ["cohort"], "vpa", "percent")


@_r.query(f"WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT} SELECT parcel_id, cohort, vpa, percent FROM percents")
def value_per_acre_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percents(spark, sf_dir).select("parcel_id", "cohort", "vpa", "percent")


@_r.query(f"""WITH {PARCELS_SQL}, {_FLAGS}, p AS (
    SELECT parcel_id, township, CASE WHEN taxable BETWEEN 100 AND 50000000 THEN taxable END AS total FROM features
), q AS (SELECT *, count(total) OVER (PARTITION BY township) AS n, rank() OVER (PARTITION BY township ORDER BY total NULLS LAST) + (count(*) OVER (PARTITION BY township, total) - 1) / 2.0 AS place FROM p)
    SELECT parcel_id, CASE WHEN total IS NULL THEN -1 WHEN n = 1 THEN 50 ELSE floor(100 * (place - 1) / (n - 1) + 0.5) END::INT AS percent FROM q""")
def value_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).select("parcel_id", "township", F.when(v.is_money(F.col("taxable_text")), v.amount(F.col("taxable_text"))).alias("total"))
    return peers.average_rank_percent(rows, ["township"], "total", "percent").select("parcel_id", "percent")


@_r.query(f"""WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT} SELECT parcel_id, exempt OR cohort IN (-1, 0) AS shows_unimproved, exempt OR cohort IN (-1, 1) AS shows_improved, TRUE AS shows_both,
    homestead AND cohort = 1 AS star_improved, homestead AS star_both FROM percents""")
def cohort_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, h = F.col("exempt"), F.col("cohort"), F.col("homestead")
    return _flags(spark, sf_dir).select("parcel_id", serving.visible(0, e, c).alias("shows_unimproved"), serving.visible(1, e, c).alias("shows_improved"), serving.visible(None, e, c).alias("shows_both"), serving.homestead_visible(1, h, c).alias("star_improved"), serving.homestead_visible(None, h, c).alias("star_both"))


@_r.query(f"""WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT}, stops(p, q, ar, ag, ab, br, bg, bb) AS (VALUES (0, 25, 5, 48, 97, 33, 102, 172), (25, 50, 33, 102, 172, 244, 165, 130), (50, 75, 244, 165, 130, 214, 96, 77), (75, 100, 214, 96, 77, 103, 0, 31))
    SELECT parcel_id, floor(ar + (br - ar) * (percent - p) / 25.0 + 0.5)::INT AS r, floor(ag + (bg - ag) * (percent - p) / 25.0 + 0.5)::INT AS g, floor(ab + (bb - ab) * (percent - p) / 25.0 + 0.5)::INT AS b
    FROM percents LEFT JOIN stops ON percent <= q AND (percent > p OR (p = 0 AND percent = 0))""")
def percentile_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percents(spark, sf_dir).select("parcel_id", serving.ramp(F.col("percent")).alias("c")).select("parcel_id", "c.*")


_NAMES_SQL = """names AS (
    SELECT *, CASE WHEN owner_raw IS NULL THEN NULL ELSE trim(regexp_replace(regexp_replace(upper(regexp_replace(owner_raw, 'L\\.L\\.C\\.', 'LLC')), '[^A-Z0-9_\\s&]', ' ', 'g'), '\\s+', ' ', 'g')) END AS owner FROM features
), kinds AS (
    SELECT *, CASE WHEN owner IS NULL THEN NULL WHEN regexp_matches(owner, 'MAINE STATE OF') THEN 'state' WHEN regexp_matches(owner, 'TOWN OF') THEN 'municipal' WHEN regexp_matches(owner, '\\bLLC\\b') THEN 'llc' ELSE 'individual' END AS kind,
        coalesce(owner = 'MAINE STATE OF', FALSE) AS institution FROM names)"""


@_r.query(f"""WITH {PARCELS_SQL}, {_NAMES_SQL} SELECT parcel_id, CASE WHEN owner IS NOT NULL AND coalesce(taxable BETWEEN 100 AND 50000000, FALSE) THEN 2 WHEN owner IS NOT NULL THEN 1 ELSE 0 END AS tier,
    CASE WHEN ordinal % 9 = 0 THEN 2 WHEN exemption > 0 THEN 1 ELSE 0 END AS program,
    CASE WHEN NOT joined THEN 'unknown' WHEN ordinal % 4 = 3 THEN 'high' WHEN ordinal % 4 IN (1, 2) THEN 'medium' ELSE 'low' END AS confidence FROM kinds""")
def coverage_symbology(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("joined"), F.element_at(F.array(*map(F.lit, (0.3, 0.6, 0.84, 0.85))), (F.col("ordinal") % 4 + 1).cast("int")))
    return parcels(spark, sf_dir).select("parcel_id", v.coverage_tier(own.is_owner(F.col("owner_raw")), F.col("taxable_text")).alias("tier"), v.program(F.col("ordinal") % 9 == 0, F.coalesce(v.exemption(F.col("exemption_text")).isNotNull(), F.lit(False))).alias("program"), v.confidence_level(score).alias("confidence"))


@_r.query(f"""WITH {PARCELS_SQL}, {_NAMES_SQL}, {_FLAGS} SELECT k.parcel_id, concat_ws(',',
        CASE WHEN k.ordinal % 7 = 0 THEN 'owner_property_card' END, CASE WHEN k.ordinal % 7 = 1 THEN 'parent_join' END, CASE WHEN k.ordinal % 5 = 0 THEN 'low_confidence' END,
        CASE WHEN owner IS NOT NULL AND k.taxable_text IS NULL THEN 'owner_without_assessment' END, CASE WHEN abs(k.acres - k.acres * 1.2) > greatest(0.5, k.acres * 1.2 * 0.1) THEN 'acreage_discrepancy' END,
        CASE WHEN owner IS NULL THEN 'missing_owner' END, CASE WHEN kind IN ('state', 'municipal') AND NOT exempt THEN 'likely_public_owner' END) AS codes
    FROM kinds k JOIN flags f USING (parcel_id)""")
def parcel_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ordinal")
    rows = parcels(spark, sf_dir).select(
        "parcel_id",
        F.when(k % 7 == 0, "property_card").when(k % 7 == 1, "map_lot_parent").otherwise("map_lot").alias("join_method"),
        F.when(k % 5 == 0, 0.3).otherwise(0.9).alias("join_confidence"),
        F.col("owner_raw").alias("owner_name"),
        F.col("taxable_text").alias("total"),
        v.acres_disagree(v.number(F.col("acres_text")), v.number(F.col("acres_text")) * 1.2).alias("acres_disagree"),
        own.is_public(own.normalize_owner(F.col("owner_raw"))).alias("public"),
        v.fully_exempt(F.col("exemption_text"), F.col("taxable_text"), F.col("land_text"), F.col("building_text")).alias("exempt"),
    )
    return rows.select("parcel_id", F.array_join(F.transform(serving.warnings(), lambda w: w["code"]), ",").alias("codes"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT parcel_id, floor(taxable * 0.0145 * 100 + 0.5) / 100 AS expected, coalesce(abs(floor(taxable * 0.0145 * 100 + 0.5) / 100 - (floor(taxable * 0.0145) + (ordinal % 3))) <= 1, NULL) AS ok FROM features""")
def mill_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxable = v.number(F.col("taxable_text"))
    check = v.mill_check(taxable, F.floor(taxable * v.MILL_RATE) + F.col("ordinal") % 3)
    return parcels(spark, sf_dir).select("parcel_id", check.alias("c")).select("parcel_id", "c.*")


@_r.query(f"""WITH {PARCELS_SQL} SELECT parcel_id || '|2025|2025-06-01' AS snapshot_id, parcel_id || '|2025|2025-06-01|features' AS feature_id, taxable_text, taxable, acres_text, acres, joined FROM features""")
def snapshot_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", "parcel_id", F.lit("2025"), F.lit("2025-06-01"))
    return features(spark, sf_dir).select(key.alias("snapshot_id"), F.concat_ws("|", key, F.lit("features")).alias("feature_id"), "taxable_text", "taxable", "acres_text", "acres", "joined")


@_r.query(f"""WITH {PARCELS_SQL} SELECT count(*) AS parcels, count(*) FILTER (WHERE joined) AS joined, count(*) FILTER (WHERE taxable IS NOT NULL) AS assessed, count(*) FILTER (WHERE allocation = 'copied_full_assessment') AS copied, count(*) FILTER (WHERE exemption IS NOT NULL) AS exempted FROM features""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).agg(F.count("*").alias("parcels"), F.count_if("joined").alias("joined"), F.count_if(F.col("taxable").isNotNull()).alias("assessed"), F.count_if(F.col("allocation") == "copied_full_assessment").alias("copied"), F.count_if(F.col("exemption").isNotNull()).alias("exempted"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT township, count(*) AS n, count(*) FILTER (WHERE owner_raw IS NOT NULL) AS with_owner, count(*) FILTER (WHERE joined) AS joined, round(count(*) FILTER (WHERE joined) / count(*), 6) AS rate, bool_or(exemption IS NOT NULL) AS any_exemption, bool_and(joined) AS all_joined FROM features GROUP BY 1""")
def coverage_by_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("township").agg(F.count("*").alias("n"), F.count("owner_raw").alias("with_owner"), F.count_if("joined").alias("joined"), F.round(F.count_if("joined") / F.count("*"), 6).alias("rate"), F.bool_or(F.col("exemption").isNotNull()).alias("any_exemption"), F.bool_and("joined").alias("all_joined"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT coalesce(township, '*') AS township, coalesce(family, '*') AS family, count(*) AS n, count(*) FILTER (WHERE joined) AS joined, max(acres) AS largest FROM features GROUP BY GROUPING SETS ((township), (family), ())""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features(spark, sf_dir).groupingSets([["township"], ["family"], []], "township", "family").agg(F.count("*").alias("n"), F.count_if("joined").alias("joined"), F.max("acres").alias("largest"))
    return out.select(F.coalesce("township", F.lit("*")).alias("township"), F.coalesce("family", F.lit("*")).alias("family"), "n", "joined", "largest")


@_r.query(f"""WITH {PARCELS_SQL} SELECT CASE WHEN NOT joined THEN 'unjoined' WHEN ordinal % 7 = 1 THEN 'map_lot_parent' ELSE 'map_lot' END AS method, count(*) AS n, round(avg(CASE WHEN joined THEN (ordinal % 10) / 10.0 END), 6) AS confidence FROM features GROUP BY 1""")
def join_method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(~F.col("joined"), "unjoined").when(F.col("ordinal") % 7 == 1, "map_lot_parent").otherwise("map_lot")
    return parcels(spark, sf_dir).groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("joined"), (F.col("ordinal") % 10) / 10.0)), 6).alias("confidence"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT family, count(*) AS n, count(*) FILTER (WHERE joined) AS joined, count(*) - count(DISTINCT group_id) AS duplicates, count(exemption) AS exemptions, count(DISTINCT custkey) AS owners FROM features GROUP BY 1""")
def family_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if("joined").alias("joined"), (F.count("*") - F.count_distinct("group_id")).alias("duplicates"), F.count("exemption").alias("exemptions"), F.count_distinct("custkey").alias("owners"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT count(*) FILTER (WHERE lots > 1) AS multi_lot, count(*) FILTER (WHERE towns > 1) AS multi_town, round(avg(lots), 6) AS lots_each FROM (SELECT custkey, count(*) AS lots, count(DISTINCT gy) AS towns FROM features GROUP BY 1)""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = parcels(spark, sf_dir).groupBy("custkey").agg(F.count("*").alias("lots"), F.count_distinct("gy").alias("towns"))
    return each.agg(F.count_if(F.col("lots") > 1).alias("multi_lot"), F.count_if(F.col("towns") > 1).alias("multi_town"), F.round(F.avg("lots"), 6).alias("lots_each"))


@_r.query(f"""WITH {POOL_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY township ORDER BY land) AS i, count(*) OVER (PARTITION BY township) AS n FROM pool) SELECT township, land AS upper_median FROM g WHERE i = n // 2 + 1""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.upper_medians(features(spark, sf_dir).where(peers.skip_reason().isNull()), ["township"], "land", "upper_median")


@_r.query(f"""WITH {PARCELS_SQL}, picks AS (
    SELECT 'unjoined' AS label, min(parcel_id) AS parcel_id FROM features WHERE unjoined UNION ALL SELECT 'vacant', min(parcel_id) FROM features WHERE vacant UNION ALL SELECT 'copied', min(parcel_id) FROM features WHERE allocation = 'copied_full_assessment'
    UNION ALL SELECT 'exempt', min(parcel_id) FROM features WHERE exemption IS NOT NULL UNION ALL SELECT 'large', min(parcel_id) FROM features WHERE band = 'ge200' UNION ALL SELECT 'ownerless', min(parcel_id) FROM features WHERE owner_raw IS NULL)
    SELECT * FROM picks WHERE parcel_id IS NOT NULL""")
def topk_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parcel that each of some predicates holds for, in one pass."""
    tests = {"unjoined": F.col("unjoined"), "vacant": F.col("vacant"), "copied": F.col("allocation") == "copied_full_assessment", "exempt": F.col("exemption").isNotNull(), "large": F.col("band") == "ge200", "ownerless": F.col("owner_raw").isNull()}
    wide = features(spark, sf_dir).agg(*[F.min_by("parcel_id", F.when(t, F.col("ordinal"))).alias(k) for k, t in tests.items()])
    return wide.unpivot([], list(tests), "label", "parcel_id").where("parcel_id is not null")


@_r.query("""SELECT s_suppkey AS id, 'Supplier ' || s_suppkey AS label, n_name AS municipality, r_name AS region, coalesce(n.n_regionkey, 0) AS region_id FROM supplier LEFT JOIN nation n ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def parcel_lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrier.plans.views import table

    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, r.r_regionkey == n.n_regionkey, "left").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("label"), F.col("n_name").alias("municipality"), F.col("r_name").alias("region"), F.coalesce("n_regionkey", F.lit(0)).alias("region_id"))


@_r.query(f"""WITH {PARCELS_SQL}, d AS (SELECT township, sha256(concat_ws('|', parcel_id, coalesce(owner_raw, ''), coalesce(taxable_text, ''))) AS h FROM features)
    SELECT township, count(*) AS n, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS checksum FROM d GROUP BY 1""")
def release_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checksum per township from the digests of its rows, in whatever order they come."""
    row = F.sha2(F.concat_ws("|", "parcel_id", F.coalesce("owner_raw", F.lit("")), F.coalesce("taxable_text", F.lit(""))), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return parcels(spark, sf_dir).groupBy("township").agg(F.count("*").alias("n"), F.bit_xor(number).alias("checksum"))


@_r.query("""SELECT o_custkey AS run_id, max(o_orderdate)::DATE AS created, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM orders GROUP BY 1""")
def run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of runs that come again replace those of the same id."""
    from terrier.operators.linkage import upsert
    from terrier.plans.views import table

    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderdate").cast("date").alias("created"))
    again = runs.where("run_id % 3 = 0").withColumn("state", F.lit("new"))
    return upsert(runs.withColumn("state", F.lit("old")), again, "run_id")
