"""Queries on owners, their graph, and observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import owners as own
from terrier.operators import observations as obs
from terrier.operators import ownership, spatial
from terrier.operators import packets as pk
from terrier.plans.places import OWNER_NORM_SQL, TOUCH_SQL, lattice, owned, points, touches
from terrier.plans.registry import Registry
from terrier.plans.scoring import scores, scores_of
from terrier.plans.views import OWNERS_SQL, PARCELS_SQL, SCORES_SQL, table
from terrier.plans.views import owners as owner_view
from terrier.sources.scratch import written

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

ROWS_SQL = f"""rows_ AS (SELECT *, {OWNER_NORM_SQL} AS owner, trim(regexp_replace(regexp_replace(upper(mail_raw), '[^A-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS mail, 'S' || (gx // 10)::VARCHAR AS sheet FROM features)"""
_KIND_SQL = "CASE WHEN {o} LIKE '%MAINE STATE OF%' THEN 'state' WHEN {o} LIKE '%TOWN OF%' THEN 'municipal' WHEN regexp_matches({o}, '\\bLLC\\b') THEN 'llc' ELSE 'individual' END"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.concat(F.lit("S"), F.floor(F.col("gx") / 10).cast("long").cast("string"))
    return owned(spark, sf_dir).withColumn("sheet", sheet)


#: What observations and packets ask of a parcel and of its scores.
_NEEDED = ("parcel_id", "ordinal", "custkey", "township", "owner", "owner_raw", "acres", "taxable", "land", "building", "land_building", "exemption", "taxable_per_acre", "vacant", "unjoined", "joined", "allocation", "family", "group_id", "band", "gx", "gy")
_SCORED = ("town_n", "town_percentile", "band_n", "band_percentile", "town_vpa_n", "town_vpa_percentile")


def _needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(spark, sf_dir, mail=False).select(*_NEEDED)


@_r.query(f"""WITH {OWNERS_SQL} SELECT custkey, {OWNER_NORM_SQL} AS owner, trim(regexp_replace(regexp_replace(upper(mail_raw), '[^A-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS mail FROM owners""")
def owner_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owner_view(spark, sf_dir).select("custkey", own.normalize_owner(F.col("owner_raw")).alias("owner"), own.normalize_mail(F.col("mail_raw")).alias("mail"))


@_r.query(f"""WITH {OWNERS_SQL}, n AS (SELECT custkey, {OWNER_NORM_SQL} AS owner FROM owners) SELECT custkey, CASE WHEN owner IS NULL THEN NULL ELSE {_KIND_SQL.format(o='owner')} END AS kind,
    coalesce(owner = 'MAINE STATE OF', FALSE) AS institution, coalesce(owner LIKE '%MAINE STATE OF%' OR owner LIKE '%TOWN OF%', FALSE) AS public FROM n""")
def owner_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = own.normalize_owner(F.col("owner_raw"))
    return owner_view(spark, sf_dir).select("custkey", o.alias("o")).select("custkey", own.owner_kind(F.col("o")).alias("kind"), own.is_institution(F.col("o")).alias("institution"), own.is_public(F.col("o")).alias("public"))


@_r.query(f"""WITH {OWNERS_SQL}, b AS (SELECT custkey, CASE custkey % 4 WHEN 0 THEN owner_raw || ' 12,500' WHEN 1 THEN owner_raw || ' 0 0 16,300' WHEN 2 THEN owner_raw || ' 1,000 2,000 0 3,000' ELSE owner_raw END AS bled, regexp_replace(trim(owner_raw), '\\s+', ' ', 'g') AS clean FROM owners)
    SELECT custkey, clean AS name, CASE WHEN clean IS NULL THEN NULL ELSE CASE custkey % 4 WHEN 0 THEN '12500' WHEN 1 THEN '16300' WHEN 2 THEN '1000' END END AS land FROM b""")
def owner_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw = F.col("custkey"), F.col("owner_raw")
    bled = F.when(k % 4 == 0, F.concat(raw, F.lit(" 12,500"))).when(k % 4 == 1, F.concat(raw, F.lit(" 0 0 16,300"))).when(k % 4 == 2, F.concat(raw, F.lit(" 1,000 2,000 0 3,000"))).otherwise(raw)
    return owner_view(spark, sf_dir).select("custkey", own.sanitize_owner(bled).alias("s")).select("custkey", "s.name", "s.land")


@_r.query(f"WITH {PARCELS_SQL}, {ROWS_SQL}, t AS (SELECT township, sum(coalesce(acres, 0)) AS ta, sum(coalesce(taxable, 0)) AS tt FROM rows_ GROUP BY 1) SELECT owner, township, count(*) AS parcels, sum(coalesce(acres, 0)) AS acres, sum(coalesce(taxable, 0)) AS taxable, CASE WHEN any_value(ta) > 0 THEN sum(coalesce(acres, 0)) / any_value(ta) END AS acre_share, CASE WHEN any_value(tt) > 0 THEN sum(coalesce(taxable, 0)) / any_value(tt) END AS taxable_share FROM rows_ JOIN t USING (township) WHERE owner IS NOT NULL GROUP BY 1, 2")
def township_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.town_shares(rows(spark, sf_dir))


_ENTITIES_SQL = f"""{PARCELS_SQL}, {ROWS_SQL}, tt AS (SELECT township, sum(coalesce(acres, 0)) AS ta FROM rows_ GROUP BY 1), al AS (SELECT sum(coalesce(acres, 0)) AS aa, sum(coalesce(taxable, 0)) AS alltax FROM rows_),
    sh AS (SELECT owner, township, sum(coalesce(acres, 0)) / any_value(ta) AS share FROM rows_ JOIN tt USING (township) WHERE owner IS NOT NULL GROUP BY 1, 2),
    ex AS (SELECT owner, string_agg(owner_raw, ';' ORDER BY turn) AS examples FROM (SELECT owner, owner_raw, row_number() OVER (PARTITION BY owner ORDER BY min(ordinal), owner_raw) AS turn FROM rows_ WHERE owner IS NOT NULL GROUP BY 1, 2) WHERE turn <= 3 GROUP BY 1),
    ent AS (SELECT owner, {_KIND_SQL.format(o='owner')} AS kind, owner = 'MAINE STATE OF' AS institution, count(*) AS parcels, sum(coalesce(acres, 0)) AS acres, sum(coalesce(taxable, 0)) AS taxable, count(DISTINCT township) AS townships FROM rows_ WHERE owner IS NOT NULL GROUP BY 1)"""


@_r.query(f"WITH {_ENTITIES_SQL} SELECT ent.*, examples, (SELECT max(share) FROM sh WHERE sh.owner = ent.owner) AS max_town_share, acres / aa AS acre_share, taxable / alltax AS taxable_share FROM ent JOIN ex USING (owner), al")
def owner_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.entities(rows(spark, sf_dir))


@_r.query(f"""WITH {PARCELS_SQL}, {ROWS_SQL}, o AS (SELECT owner, sum(coalesce(acres, 0)) AS aa FROM rows_ WHERE owner IS NOT NULL GROUP BY 1),
    m AS (SELECT 'township' AS scope, township AS scope_id, owner, unnest(['acres', 'taxable']) AS metric, unnest([sum(coalesce(acres, 0)), sum(coalesce(taxable, 0))]) AS value FROM rows_ GROUP BY township, owner
          UNION ALL SELECT 'all', 'all', owner, unnest(['acres', 'taxable']), unnest([sum(coalesce(acres, 0)), sum(coalesce(taxable, 0))]) FROM rows_ GROUP BY owner),
    s AS (SELECT *, sum(value) OVER (PARTITION BY scope, scope_id, metric) AS total FROM m),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY scope, scope_id, metric ORDER BY value DESC, aa DESC, owner) AS rank FROM s JOIN o USING (owner))
    SELECT scope, scope_id, metric, rank::INT AS rank, owner, value, CASE WHEN total > 0 THEN value / total END AS share FROM r WHERE rank <= 10""")
def ownership_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.concentration(rows(spark, sf_dir))


@_r.query(f"""WITH {OWNERS_SQL}, p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 100003)::DOUBLE AS x, (c_custkey * 104729 % 100019)::DOUBLE AS y, floor(c_acctbal + 1000)::DOUBLE AS acres FROM customer),
    k AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.id) <= 5),
    n AS (SELECT custkey, {OWNER_NORM_SQL} AS owner FROM owners), h AS (SELECT id, other FROM k UNION ALL SELECT id, id FROM p),
    s AS (SELECT h.id, a.owner, sum(CASE WHEN b.owner = a.owner THEN q.acres ELSE 0 END) AS same, sum(q.acres) AS total FROM h JOIN n a ON a.custkey = h.id JOIN n b ON b.custkey = h.other JOIN p q ON q.id = h.other WHERE a.owner IS NOT NULL GROUP BY 1, 2)
    SELECT owner, max(same / total) AS share FROM s WHERE total > 0 GROUP BY 1""")
def owner_knn_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = owner_view(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("custkey") == F.col("c_custkey")).select(F.col("custkey").alias("parcel_id"), own.normalize_owner(F.col("owner_raw")).alias("owner"), F.floor(F.col("c_acctbal") + 1000).cast("double").alias("acres"))
    return ownership.knn_share(held, spatial.nearest(points(spark, sf_dir), k=5))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    word = lambda i: F.upper(F.element_at(F.split("p_name", " "), i))
    plain = p.select(F.concat(word(1), F.lit(" "), word(2)).alias("owner"), F.concat(F.lit("T"), (F.col("p_size") % 5).cast("string")).alias("township"), F.lit(None).cast("string").alias("mail"))
    agency = p.where("p_partkey % 7 = 0").select(F.concat(word(1), F.lit(" "), word(2), F.lit(" BGS")).alias("owner"), F.lit("T9").alias("township"), F.lit(None).cast("string").alias("mail"))
    swapped = p.where("p_partkey % 5 = 0").select(F.concat(word(2), F.lit(" "), word(1), F.lit("S")).alias("owner"), F.concat(F.lit("T"), (F.col("p_size") % 5).cast("string")).alias("township"), F.lit(None).cast("string").alias("mail"))
    return plain.unionByName(agency).unionByName(swapped).distinct()


_NAMES_SQL = """w AS (SELECT *, upper(split_part(p_name, ' ', 1)) AS w1, upper(split_part(p_name, ' ', 2)) AS w2, 'T' || (p_size % 5)::VARCHAR AS t FROM part),
    nm AS (SELECT DISTINCT * FROM (SELECT w1 || ' ' || w2 AS owner, t AS township FROM w UNION ALL SELECT w1 || ' ' || w2 || ' BGS', 'T9' FROM w WHERE p_partkey % 7 = 0 UNION ALL SELECT w2 || ' ' || w1 || 'S', t FROM w WHERE p_partkey % 5 = 0))"""


# No SQL: DuckDB's jaro_similarity rounds halves of transpositions down, which this measure doesn't.
@_r.query()
def name_similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return ownership.similar_edges(ownership.candidate_pairs(_names(spark, sf_dir), none)).select("a", "b", F.round("score", 7).alias("score"), "type")


@_r.query(f"WITH {_NAMES_SQL}, o AS (SELECT DISTINCT owner FROM nm) SELECT x.owner AS a, y.owner AS b FROM o x JOIN o y ON y.owner = x.owner || ' BGS'")
def agency_variant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.agency_edges(_names(spark, sf_dir))


@_r.query(f"WITH {PARCELS_SQL}, {ROWS_SQL}, e AS (SELECT DISTINCT owner, mail FROM rows_ WHERE owner IS NOT NULL) SELECT x.owner AS a, y.owner AS b, mail FROM e x JOIN e y USING (mail) WHERE x.owner < y.owner")
def same_mail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.same_mail_edges(rows(spark, sf_dir))


@_r.query(f"""WITH {PARCELS_SQL}, p AS (SELECT x.parcel_id AS a, y.parcel_id AS b, coalesce(x.allocation = 'copied_full_assessment', FALSE) OR coalesce(y.allocation = 'copied_full_assessment', FALSE) AS c FROM features x JOIN features y ON x.group_id = y.group_id AND x.parcel_id < y.parcel_id)
    SELECT 'same_property_id' AS type, a, b FROM p UNION ALL SELECT 'copied_assessment', a, b FROM p WHERE c""")
def multi_lot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.group_edges(rows(spark, sf_dir))


_SRC = "CASE WHEN joined THEN 'valuation' ELSE 'geometry' END"


@_r.query(f"""WITH {PARCELS_SQL}, {ROWS_SQL} SELECT DISTINCT type, type || ':' || key AS id FROM (SELECT unnest(['source', 'parcel', 'township', 'map_sheet', 'mail', 'owner_string', 'normalized_owner']) AS type, unnest([{_SRC}, parcel_id, township, sheet, mail, owner_raw, owner]) AS key FROM rows_) WHERE key IS NOT NULL""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.graph_nodes(rows(spark, sf_dir))


@_r.query(f"""WITH {PARCELS_SQL}, {ROWS_SQL} SELECT 'from_source' AS type, 'parcel:' || parcel_id AS source, 'source:' || {_SRC} AS target FROM rows_ UNION ALL SELECT 'in_township', 'parcel:' || parcel_id, 'township:' || township FROM rows_ UNION ALL SELECT 'on_map_sheet', 'parcel:' || parcel_id, 'map_sheet:' || sheet FROM rows_
    UNION ALL SELECT 'owns', 'owner_string:' || owner_raw, 'parcel:' || parcel_id FROM rows_ WHERE owner_raw IS NOT NULL UNION ALL SELECT DISTINCT 'normalizes_to', 'owner_string:' || owner_raw, 'normalized_owner:' || owner FROM rows_ WHERE owner IS NOT NULL""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.structural_edges(rows(spark, sf_dir))


def _touching(every: DataFrame) -> DataFrame:
    """Touches of parcels, each once, with what the rules ask of either end."""
    return spatial.touching_once(lattice(every, *obs.KNOWN, "gx", "joined")).drop("distance")


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned_pairs(_touching(_needed(spark, sf_dir)))


def _owned_pairs(touching: DataFrame) -> DataFrame:
    """Touches of parcels whose owners are known, each once, with these."""
    return touching.select("id", "neighbour_id", F.col("own.owner").alias("oa"), F.col("other.owner").alias("ob")).where("oa is not null and ob is not null")


@_r.query(f"WITH {PARCELS_SQL}, {TOUCH_SQL}, {ROWS_SQL} SELECT id, neighbour_id, a.owner FROM touch JOIN rows_ a ON a.parcel_id = id JOIN rows_ b ON b.parcel_id = neighbour_id WHERE id < neighbour_id AND a.owner = b.owner")
def adjacent_same_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).where("oa = ob").select("id", "neighbour_id", F.col("oa").alias("owner"))


# Observations.


@_r.query(f"""WITH {PARCELS_SQL}, g AS (SELECT group_id, count(*) AS n, bool_or(coalesce(allocation = 'copied_full_assessment', FALSE)) AS c, min(acres) AS a, max(acres) AS z, count(*) FILTER (WHERE acres > 0) AS k, string_agg(parcel_id, ',' ORDER BY parcel_id) AS parcels FROM features GROUP BY 1)
    SELECT 'obs:copied_multilot_acre_spread:' || group_id AS id, z / a AS observed, parcels FROM g WHERE n >= 2 AND c AND k >= 2 AND z / a >= 3 AND z - a >= 10""")
def obs_copied_multilot_acre_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.copied_acre_spread(rows(spark, sf_dir)).select("id", "observed", F.array_join("parcels", ",").alias("parcels"))


@_r.query(f"""WITH {PARCELS_SQL}, h AS (SELECT township, parcel_id FROM features WHERE exemption IS NULL AND land_building - taxable >= 1000 AND (taxable <= 0 OR land_building / taxable >= 1.25))
    SELECT 'obs:land_building_vs_taxable_exemption_null:' || township AS id, count(*)::DOUBLE AS observed, min(parcel_id) AS first FROM h GROUP BY township""")
def obs_land_building_vs_taxable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.parts_above_taxable(rows(spark, sf_dir)).select("id", "observed", F.col("parcels")[0].alias("first"))


@_r.query(f"""WITH {PARCELS_SQL}, {TOUCH_SQL}, s AS (SELECT t.id, count(*) AS n, count(*) FILTER (WHERE f.family = 'wa_map' AND NOT f.unjoined) AS j FROM touch t LEFT JOIN features f ON f.parcel_id = t.neighbour_id GROUP BY 1)
    SELECT 'obs:unjoined_plat_hole:' || township AS id, count(*)::DOUBLE AS observed FROM features JOIN s ON s.id = parcel_id WHERE unjoined AND n >= 3 AND j / n >= 0.75 GROUP BY township""")
def obs_unjoined_plat_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.plat_holes(_touching(_needed(spark, sf_dir))).select("id", "observed")


@_r.query(f"""WITH {PARCELS_SQL}, {TOUCH_SQL}, {ROWS_SQL}, s AS (SELECT t.id, count(*) AS n, count(*) FILTER (WHERE NOT f.vacant AND NOT f.unjoined) AS j FROM touch t LEFT JOIN features f ON f.parcel_id = t.neighbour_id GROUP BY 1)
    SELECT 'obs:vacant_tract_among_improved:' || coalesce(owner, '_unknown') AS id, count(*)::DOUBLE AS observed, CASE WHEN any_value(owner) = 'MAINE STATE OF' THEN 'suppressed' ELSE 'low' END AS priority FROM rows_ JOIN s ON s.id = parcel_id WHERE vacant AND acres >= 100 AND n >= 3 AND j / n >= 0.75 GROUP BY owner""")
def obs_vacant_among_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.vacant_among_improved(_touching(_needed(spark, sf_dir))).select("id", "observed", "priority")



@_r.query(f"""WITH {PARCELS_SQL}, {TOUCH_SQL}, f AS (SELECT parcel_id, 'Z' || (gx // 10)::VARCHAR AS z, (gx // 10) % 5 <> 0 AND joined AS j FROM features), s AS (SELECT z, count(*) AS n, count(*) FILTER (WHERE j) AS k FROM f GROUP BY 1),
    d AS (SELECT DISTINCT a.z AS a, b.z AS b FROM touch JOIN f a ON a.parcel_id = id JOIN f b ON b.parcel_id = neighbour_id WHERE a.z <> b.z)
    SELECT 'obs:township_join_gap:' || s.z AS id, s.k / s.n AS observed, s.n AS parcels FROM s WHERE s.k / s.n <= 0.05 AND EXISTS (SELECT 1 FROM d JOIN s o ON o.z = d.b WHERE d.a = s.z AND o.k / o.n >= 0.9)""")
def obs_township_join_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = written(_needed(spark, sf_dir), "rows")
    return _join_gaps(r, _touching(r)).select("id", "observed", F.col("parcel_count").alias("parcels"))


def _join_gaps(r: DataFrame, touching: DataFrame) -> DataFrame:
    zone = lambda gx: F.floor(F.col(gx) / 10)
    town = lambda gx: F.concat(F.lit("Z"), zone(gx).cast("long").cast("string")).alias("township")
    zoned = r.select("parcel_id", town("gx"), (~((zone("gx") % 5 != 0) & F.col("joined"))).alias("unjoined"))
    return obs.join_gaps(zoned, touching.select(*[F.struct(town(f"{p}.gx")).alias(p) for p in ("own", "other")]))


@_r.query(f"WITH {PARCELS_SQL} SELECT 'obs:unjoined_tax_records:2025' AS id, count(*)::DOUBLE AS observed FROM features WHERE unjoined HAVING count(*) > 0")
def obs_unjoined_tax_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.unjoined_records(rows(spark, sf_dir), 2025).select("id", "observed")


@_r.query(f"""WITH {SCORES_SQL}, p AS (SELECT parcel_id, custkey, township, CASE WHEN band_n >= 12 THEN band_percentile WHEN town_n >= 12 THEN town_percentile END AS pct FROM scores)
    SELECT 'obs:mail_organized_peer_deviant:all' AS id, count(*)::DOUBLE AS observed FROM p WHERE custkey % 25 < 5 AND township NOT IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') AND (pct <= 0.05 OR pct >= 0.95) HAVING count(*) > 0""")
def obs_mail_organized_peer_deviant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_elsewhere(spark, sf_dir, scores(spark, sf_dir, "town", "band", spread=False)).select("id", "observed")


def _mail_elsewhere(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    towns = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("township"))
    return obs.mail_elsewhere(scored.withColumn("mail_town", F.concat(F.lit("NATION_"), (F.col("custkey") % 25).cast("string"))), towns)


@_r.query(f"""WITH {SCORES_SQL}, {ROWS_SQL}, tt AS (SELECT township, sum(coalesce(acres, 0)) AS ta FROM rows_ GROUP BY 1), sh AS (SELECT owner, township, sum(coalesce(acres, 0)) / any_value(ta) AS share FROM rows_ JOIN tt USING (township) WHERE owner IS NOT NULL GROUP BY 1, 2),
    low AS (SELECT r.owner, r.township, r.parcel_id, r.ordinal, s.town_vpa_percentile AS pct FROM rows_ r JOIN scores s USING (parcel_id) WHERE r.vacant AND s.town_vpa_n >= 12 AND s.town_vpa_percentile <= 0.1)
    SELECT 'obs:high_local_share_low_vpa:' || owner || '~' || township AS id, share, arg_min(pct, ordinal) AS percentile, CASE WHEN owner = 'MAINE STATE OF' THEN 'suppressed' ELSE 'medium' END AS priority, count(*) AS parcels FROM sh JOIN low USING (owner, township) WHERE share >= 0.02 GROUP BY owner, township, share""")
def obs_high_share_low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a share of 2 % rather than 20 %, which no owner here has."""
    r = rows(spark, sf_dir)
    found = obs.high_share_low_value(r, ownership.town_shares(r), scores(spark, sf_dir, "town_vpa", spread=False), min_share=0.02)
    return found.select("id", F.col("share"), "percentile", "priority", F.col("parcel_count").alias("parcels"))


#: Pairs of owners (a < b) with similar names whose land touches, with their score; and each owner's group.
_SIMILAR_SQL = """adj AS (
        SELECT DISTINCT least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b FROM touch JOIN rows_ a ON a.parcel_id = id JOIN rows_ b ON b.parcel_id = neighbour_id WHERE a.owner <> b.owner
    ), sc AS (
        SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM adj
    ), sj AS (
        SELECT a, b, jaro_similarity(x, y) AS j, (substr(x, 1, 1) = substr(y, 1, 1))::INT + (substr(x, 1, 2) = substr(y, 1, 2))::INT + (substr(x, 1, 3) = substr(y, 1, 3))::INT + (substr(x, 1, 4) = substr(y, 1, 4))::INT AS p FROM sc
    ), e AS (
        SELECT a, b, j + p * 0.1 * (1 - j) AS score FROM sj WHERE j + p * 0.1 * (1 - j) >= 0.92
    ), l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), w AS (SELECT u AS n, u AS seen FROM l UNION SELECT w.n, l.v FROM w JOIN l ON l.u = w.seen), c AS (SELECT n, min(seen) AS root FROM w GROUP BY 1),
    edges AS (SELECT root, count(*) AS edges, max(score) AS top FROM e JOIN c ON c.n = e.a GROUP BY 1)"""


@_r.query(f"""WITH RECURSIVE {PARCELS_SQL}, {TOUCH_SQL}, {ROWS_SQL}, {_SIMILAR_SQL}
    SELECT 'obs:similar_name_adjacent:' || string_agg(n, '~' ORDER BY n) AS id, count(*) AS owners, any_value(edges) AS edges, round(any_value(top), 6) AS top_score FROM c JOIN edges USING (root) GROUP BY root""")
def obs_similar_name_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar_neighbours(spark, _adjacent(spark, sf_dir)).select("id", F.size("owners").cast("long").alias("owners"), F.col("relation_count").alias("edges"), F.round("top_score", 6).alias("top_score"))


def _similar_neighbours(spark: SparkSession, adjacent: DataFrame, every: DataFrame | None = None) -> DataFrame:
    pairs = adjacent.where("oa != ob").select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))
    none = spark.createDataFrame([], "owner string, township string, mail string")
    return obs.similar_neighbours(ownership.similar_edges(ownership.candidate_pairs(none, pairs)).where("type = 'similar_name' and adjacent"), every)


def _observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The observations of all nine rules, and the parcels. Parcels, touches and scores are written once, and the latter two are made of the parcels as written. What the rules ask of touching parcels goes along with the shapes, so no rule joins the touches."""
    r = written(_needed(spark, sf_dir), "rows")
    t, s = _touching(r), written(scores_of(r, "town", "band", "town_vpa", spread=False, held=True).select("parcel_id", "custkey", "township", *_SCORED), "scores")
    found = [
        obs.copied_acre_spread(r),
        obs.parts_above_taxable(r),
        obs.plat_holes(t),
        obs.vacant_among_improved(t),
        _join_gaps(r, t),
        obs.unjoined_records(r, 2025),
        _mail_elsewhere(spark, sf_dir, s),
        obs.high_share_low_value(r, ownership.town_shares(r), s, min_share=0.02),
        _similar_neighbours(spark, _owned_pairs(t), r),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), r


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, r = _observations(spark, sf_dir)
    return pk.build_packets(written(every, "observations"), r, ownership.entities(r))


#: By query: the rule's name, what its flags make of it, and whether a row is an institution's, in SQL.
_RULES = {
    "obs_copied_multilot_acre_spread": ("copied_multilot_acre_spread", "'artifact'"),
    "obs_land_building_vs_taxable": ("land_building_vs_taxable_exemption_null", "'unexplained'"),
    "obs_unjoined_plat_hole": ("unjoined_plat_hole", "'artifact'"),
    "obs_vacant_among_improved": ("vacant_tract_among_improved", "CASE WHEN priority = 'suppressed' THEN 'institutional_baseline' ELSE 'unexplained' END"),
    "obs_township_join_gap": ("township_join_gap", "'artifact'"),
    "obs_unjoined_tax_records": ("unjoined_tax_records", "'artifact'"),
    "obs_mail_organized_peer_deviant": ("mail_organized_peer_deviant", "'unexplained'"),
    "obs_high_share_low_value": ("high_local_share_low_vpa", "CASE WHEN priority = 'suppressed' THEN 'institutional_baseline' ELSE 'unexplained' END"),
    "obs_similar_name_adjacent": ("similar_name_adjacent", "CASE WHEN top_score >= 0.999 THEN 'ordinary' ELSE 'unexplained' END"),
}
#: A row for each observation, by the rules' own SQL.
_EACH_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS type, {class_} AS class, id FROM ({_r.sql[query]})" for query, (kind, class_) in _RULES.items())

#: The parcels that each observation names, by the rules that name any.
_NAMED_SQL = f"""SELECT 'obs:copied_multilot_acre_spread:' || f.group_id AS id, parcel_id FROM features f JOIN copied USING (group_id)
    UNION ALL SELECT 'obs:land_building_vs_taxable_exemption_null:' || township, parcel_id FROM features WHERE exemption IS NULL AND land_building - taxable >= 1000 AND (taxable <= 0 OR land_building / taxable >= 1.25)
    UNION ALL SELECT 'obs:unjoined_plat_hole:' || township, parcel_id FROM features JOIN around ON around.id = parcel_id WHERE unjoined AND n >= 3 AND mapped / n >= 0.75
    UNION ALL SELECT 'obs:vacant_tract_among_improved:' || coalesce(owner, '_unknown'), parcel_id FROM rows_ JOIN around ON around.id = parcel_id WHERE vacant AND acres >= 100 AND n >= 3 AND improved / n >= 0.75
    UNION ALL SELECT 'obs:high_local_share_low_vpa:' || r.owner || '~' || r.township, r.parcel_id FROM rows_ r JOIN scores s USING (parcel_id) JOIN sh ON sh.owner = r.owner AND sh.township = r.township
              WHERE r.vacant AND s.town_vpa_n >= 12 AND s.town_vpa_percentile <= 0.1 AND share >= 0.02
    UNION ALL SELECT g.id, parcel_id FROM ({_r.sql['obs_township_join_gap']}) g JOIN features ON g.id = 'obs:township_join_gap:Z' || (gx // 10)
    UNION ALL SELECT 'obs:mail_organized_peer_deviant:all', parcel_id FROM (SELECT *, CASE WHEN band_n >= 12 THEN band_percentile WHEN town_n >= 12 THEN town_percentile END AS pct FROM scores)
              WHERE custkey % 25 < 5 AND township NOT IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') AND (pct <= 0.05 OR pct >= 0.95)
    UNION ALL SELECT id, parcel_id FROM holds JOIN rows_ USING (owner) WHERE starts_with(id, 'obs:similar_name_adjacent:')"""

#: The owners that each observation names.
_HOLDS_SQL = f"""SELECT id, substr(id, 33) AS owner FROM ({_r.sql['obs_vacant_among_improved']}) WHERE id <> 'obs:vacant_tract_among_improved:_unknown'
    UNION ALL SELECT id, split_part(substr(id, 30), '~', 1) FROM ({_r.sql['obs_high_share_low_value']})
    UNION ALL SELECT id, unnest(string_split(substr(id, 27), '~')) FROM ({_r.sql['obs_similar_name_adjacent']})"""


@_r.query(f"""
    WITH RECURSIVE {SCORES_SQL}, {TOUCH_SQL}, {ROWS_SQL}, {_SIMILAR_SQL}, copied AS (
        SELECT group_id, n FROM (SELECT group_id, count(*) AS n, bool_or(coalesce(allocation = 'copied_full_assessment', FALSE)) AS c, min(acres) AS a, max(acres) AS z, count(*) FILTER (WHERE acres > 0) AS k FROM features GROUP BY 1)
        WHERE n >= 2 AND c AND k >= 2 AND z / a >= 3 AND z - a >= 10
    ), around AS (
        SELECT t.id, count(*) AS n, count(*) FILTER (WHERE f.family = 'wa_map' AND NOT f.unjoined) AS mapped, count(*) FILTER (WHERE NOT f.vacant AND NOT f.unjoined) AS improved FROM touch t LEFT JOIN features f ON f.parcel_id = t.neighbour_id GROUP BY 1
    ), tt AS (SELECT township, sum(coalesce(acres, 0)) AS ta FROM rows_ GROUP BY 1
    ), sh AS (SELECT owner, township, sum(coalesce(acres, 0)) / any_value(ta) AS share FROM rows_ JOIN tt USING (township) WHERE owner IS NOT NULL GROUP BY 1, 2
    ), holds AS ({_HOLDS_SQL}), o AS ({_NAMED_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY parcel_id) AS i, count(*) OVER (PARTITION BY id) AS named FROM o
    ), held AS (
        SELECT r.id, string_agg(r.parcel_id, ',' ORDER BY r.parcel_id) AS parcels, sum(coalesce(taxable, 0)) AS taxable, count(*) AS n, any_value(named) AS named FROM r JOIN features USING (parcel_id) WHERE i <= 25 GROUP BY 1
    ), firsts AS (
        SELECT id, owner FROM holds QUALIFY row_number() OVER (PARTITION BY id ORDER BY owner) <= 25
    ), owned AS (SELECT id, sum(k)::BIGINT AS owner_parcels FROM firsts JOIN (SELECT owner, count(*) AS k FROM rows_ GROUP BY 1) USING (owner) GROUP BY 1
    ), related AS (
        SELECT 'obs:copied_multilot_acre_spread:' || group_id AS id, n - 1 AS relations FROM copied UNION ALL SELECT id, edges FROM ({_r.sql['obs_similar_name_adjacent']})
    )
    SELECT e.id, coalesce(parcels, '') AS parcels, coalesce(taxable, 0.0) AS taxable, coalesce(n, 0) AS n, coalesce(named, 0) AS named, coalesce(owner_parcels, 0) AS owner_parcels, coalesce(relations, 0) AS relations, least(25, coalesce(relations, 0)) AS shown_relations
    FROM ({_EACH_SQL}) e LEFT JOIN held USING (id) LEFT JOIN owned USING (id) LEFT JOIN related USING (id)""")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packets hold: the first parcels and how many are named, what the named owners hold, and relations."""
    p = _packets(spark, sf_dir)
    total = lambda of, c, zero: F.aggregate(of, zero, lambda s, x: s + F.coalesce(x[c], zero))
    return p.select(
        "id", F.array_join(F.transform("parcels", lambda x: x["parcel_id"]), ",").alias("parcels"), total("parcels", "taxable", F.lit(0.0)).alias("taxable"), F.size("parcels").cast("long").alias("n"),
        F.col("parcel_count").alias("named"), total("owners", "parcel_count", F.lit(0).cast("long")).alias("owner_parcels"), F.col("relation_count").alias("relations"), F.size("relations").cast("long").alias("shown_relations"),
    )


@_r.query(f"""SELECT id, way, CASE way WHEN 'accuses' THEN 'forbidden vocabulary' WHEN 'invents' THEN 'uncited number 987654321' WHEN 'foreign' THEN 'observation id mismatch' WHEN 'all' THEN 'forbidden vocabulary,uncited number 987654.5,observation id mismatch' ELSE '' END AS errors
    FROM ({_EACH_SQL}), (SELECT unnest(['told', 'accuses', 'invents', 'foreign', 'long', 'all']) AS way) w""")
def packet_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each packet, as it is and made wrong in each of the ways that count; a number of more than twelve places isn't checked."""
    p = written(_packets(spark, sf_dir), "packets")
    ways = {"told": "", "accuses": " That is FRAUD.", "invents": " It was 987654321.", "foreign": "", "long": " See 1234567890123.", "all": " Stolen: 987654.5"}
    each = pk.hypotheses(p).select("id", "about", "text", F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.lit(t).alias("more")) for w, t in ways.items()])).alias("w"))
    said = each.select("id", F.when(F.col("w.way").isin("foreign", "all"), "obs:other").otherwise(F.col("about")).alias("about"), F.concat("text", F.col("w.more")).alias("text"), "w.way")
    return pk.validate(p, said).select("id", "way", F.array_join("errors", ",").alias("errors"))


@_r.query(f"SELECT class, count(*) AS n FROM ({_EACH_SQL}) GROUP BY 1")
def packet_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, _ = _observations(spark, sf_dir)
    return every.groupBy(pk.classify().alias("class")).agg(F.count("*").alias("n"))


@_r.query(f"SELECT type, count(*) AS n FROM ({_EACH_SQL}) GROUP BY 1")
def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, _ = _observations(spark, sf_dir)
    return every.groupBy("type").agg(F.count("*").alias("n"))
