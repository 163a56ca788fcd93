"""Queries on codes, mail hints, consistency, colours and audits; codes and addresses are put together from parts and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import codes
from terrier.functions import values as v
from terrier.operators import audits
from terrier.plans.registry import Registry
from terrier.plans.views import PARCELS_SQL, parcels, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _text(x: Column) -> Column:
    return x.cast("string")


@_r.query("""SELECT p_partkey AS id,
        CASE k WHEN 0 THEN 'wa_map' WHEN 1 THEN 'wap_plat' WHEN 2 THEN 'pe_plat' WHEN 3 THEN 'pe_plat' WHEN 4 THEN 'ha_plat' WHEN 5 THEN 'arp_plat' WHEN 6 THEN 'unknown' END AS family,
        CASE WHEN k = 0 THEN 'WA' || m || '|0' || p_partkey % 7 || '-' || p_partkey || 'b' END AS map_key,
        CASE k WHEN 1 THEN 'WAP' || t WHEN 2 THEN 'PEP1' WHEN 3 THEN 'PE01' WHEN 4 THEN 'HA' || t WHEN 5 THEN 'ARP1' END AS plat_code,
        CASE WHEN k = 7 THEN NULL WHEN p_partkey % 3 = 0 THEN 'given' WHEN k = 1 THEN '04-' || p_partkey || 'X' END AS plan_lot
    FROM (SELECT p_partkey, p_partkey % 8 AS k, lpad((p_partkey % 900)::VARCHAR, 3, '0') AS m, lpad((p_partkey % 90)::VARCHAR, 2, '0') AS t FROM part)""")  # fmt: skip
def tpl_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("p_partkey")
    m, t = F.lpad(_text(id_ % 900), 3, "0"), F.lpad(_text(id_ % 90), 2, "0")
    made = (
        F.concat(F.lit(" wa"), m, F.lit("0"), _text(id_ % 7), _text(id_), F.lit(" B ")),
        F.concat(F.lit("WAP"), t, F.lit("04"), _text(id_), F.lit("x")),
        F.concat(F.lit("PEP1"), _text(id_)),
        F.concat(F.lit("pe01"), _text(id_)),
        F.concat(F.lit("HA"), t, _text(id_)),
        F.concat(F.lit("ARP1"), _text(id_)),
        F.concat(F.lit("ZZ"), _text(id_)),
        F.lit(None).cast("string"),
    )
    code = F.element_at(F.array(*made), (id_ % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(id_.alias("id"), codes.decode_tpl(code, F.when(id_ % 3 == 0, "given")).alias("d"))
    return rows.select("id", "d.family", "d.map_key", "d.plat_code", "d.plan_lot")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = (
        F.concat(_text(k), F.lit(" Elm Rd, "), F.col("n_name"), F.lit(" Plt, ME")),
        F.concat(F.lit("PO Box "), _text(k), F.lit("  Trescott Twp ME")),
        F.lit("Far Upper Lower Old Red Twp"),
        F.concat(F.lit("Camp T"), _text(k % 90), F.lit(" nd BPP")),
        F.concat(F.lit("T"), _text(k % 90), F.lit(" R3 NBPP, ME")),
        F.concat(_text(k), F.lit(" Main St")),
        F.concat(_text(k), F.lit(" Rd Plt")),
        F.lit(None).cast("string"),
    )
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(k.alias("id"), F.col("n_name").alias("name"), "n_nationkey", F.element_at(F.array(*made), (k % 8 + 1).cast("int")).alias("address"))


_HINT_SQL = """hints AS (SELECT c_custkey AS id, n_name AS name, n_nationkey, CASE c_custkey % 8 WHEN 0 THEN replace(lower(n_name), '_', '-') || '-plt' WHEN 1 THEN 'trescott-twp' WHEN 2 THEN 'upper-lower-old-red-twp'
        WHEN 3 THEN 't' || c_custkey % 90 || '-nd-bpp' WHEN 4 THEN 't' || c_custkey % 90 || '-r3-nbpp' END AS hint FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@_r.query(f"WITH {_HINT_SQL} SELECT id, hint FROM hints")
def mail_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("id", codes.mail_hint(F.col("address")).alias("hint"))


_ENDINGS = (" Township", " Plantation", " Division", " twp", "")


@_r.query("""SELECT c_custkey AS id, 'place-' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '-twp' WHEN 1 THEN '-plt' WHEN 2 THEN '-division' WHEN 3 THEN '-twp' ELSE '' END AS municipality, c_custkey % 5 = 3 AS unorganized FROM customer""")
def division_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit(" Place "), _text(k), F.element_at(F.array(*map(F.lit, _ENDINGS)), (k % 5 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), codes.division_id(name).alias("municipality"), codes.is_unorganized(name).alias("unorganized"))


@_r.query(f"""WITH {_HINT_SQL} SELECT id, coalesce(hint, CASE WHEN n_nationkey % 2 = 0 THEN 'sheet-' || n_nationkey END, CASE WHEN id % 3 <> 0 THEN replace(lower(name), '_', '-') || '-twp' END) AS municipality FROM hints""")
def municipality_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mail, else by the map sheet, else by the division. Sheets are joined as a table of their own; half of them name no municipality."""
    sheets = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.array(F.concat(F.lit("sheet-"), _text(F.col("n_nationkey"))), F.lit("other")).alias("ids"))
    rows = _addresses(spark, sf_dir).join(sheets, "n_nationkey", "left")
    division = F.when(F.col("id") % 3 != 0, F.concat("name", F.lit(" Township")))
    return rows.select("id", codes.municipality_of(F.col("address"), F.col("ids"), division).alias("municipality"))


@_r.query(f"""WITH {PARCELS_SQL} SELECT parcel_id, CASE WHEN taxable IS NULL THEN TRUE WHEN taxable * 20 > 5000000 AND ordinal % 5 = 0 THEN FALSE
        ELSE NOT (coalesce(land, 0) > 0 AND coalesce(building, 0) > 0 AND t > 0 AND ((building > t * 1.25 AND land > t) OR (land > t * 1.25 AND building > t) OR t > land + building + 10000)) END AS consistent
    FROM (SELECT *, CASE ordinal % 5 WHEN 0 THEN taxable * 20 WHEN 1 THEN floor(taxable / 4) ELSE taxable END AS t FROM features)""")
def assessment_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every fifth parcel are twentyfold, of every fifth a quarter, so that all rules apply to some."""
    k, taxable = F.col("ordinal"), F.col("taxable_text").cast("long")
    total = F.when(k % 5 == 0, taxable * 20).when(k % 5 == 1, F.floor(taxable / 4)).otherwise(taxable)
    return parcels(spark, sf_dir).select("parcel_id", codes.assessment_consistent(F.col("land_text"), F.col("building_text"), total.cast("string")).alias("consistent"))


@_r.query(f"""WITH {PARCELS_SQL}, s AS (SELECT parcel_id, CASE WHEN ordinal % 9 = 0 THEN 2 WHEN exemption > 0 THEN 1 ELSE 0 END AS p, CASE WHEN owner_raw IS NOT NULL AND coalesce(taxable BETWEEN 100 AND 50000000, FALSE) THEN 2 WHEN owner_raw IS NOT NULL THEN 1 ELSE 0 END AS t, ordinal % 4 = 0 AS low FROM features)
    SELECT parcel_id, CASE WHEN p = 2 THEN CASE WHEN w THEN '#3f563d' ELSE '#4d6b4a' END WHEN p = 1 THEN CASE WHEN w THEN '#d97050' ELSE '#f2845c' END WHEN t = 2 THEN CASE WHEN w THEN '#a68b2a' ELSE '#c9a227' END WHEN t = 1 THEN CASE WHEN w THEN '#4a8075' ELSE '#5a9a8c' END ELSE '#8aa4b0' END AS fill,
        CASE WHEN p = 2 THEN CASE WHEN w THEN '#2b3a28' ELSE '#354a32' END WHEN p = 1 THEN CASE WHEN w THEN '#b05838' ELSE '#d46540' END WHEN t = 2 THEN CASE WHEN w THEN '#6d5a1a' ELSE '#8a7020' END WHEN t = 1 THEN CASE WHEN w THEN '#325a52' ELSE '#3d6b62' END ELSE '#4a6a72' END AS line
    FROM (SELECT *, t > 0 AND low AS w FROM s)""")
def coverage_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ordinal")
    program = v.program(k % 9 == 0, F.coalesce(v.exemption(F.col("exemption_text")).isNotNull(), F.lit(False)))
    tier = v.coverage_tier(F.col("owner_raw").isNotNull(), F.col("taxable_text"))
    rows = parcels(spark, sf_dir).select("parcel_id", codes.coverage_colours(program, tier, (tier > 0) & (k % 4 == 0)).alias("c"))
    return rows.select("parcel_id", "c.fill", "c.line")


@_r.query(f"""WITH {PARCELS_SQL}, c AS (SELECT township, count(*) AS counted FROM features GROUP BY 1), p AS (SELECT n_name AS township, n_nationkey, CASE WHEN n_nationkey % 4 <> 3 THEN counted + CASE WHEN n_nationkey % 4 = 1 THEN 2 ELSE 0 END END AS published FROM nation JOIN c ON n_name = township)
    SELECT township, published, counted, abs(published - counted) AS delta, coalesce(published = counted, TRUE) AS ok FROM p JOIN c USING (township)""")
def manifest_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published counts are those of the table, but for every fourth township, of which two more are published, and every fourth without any."""
    rows = parcels(spark, sf_dir).select("township")
    towns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("township"), (F.col("n_nationkey") % 4).alias("k"))
    counts = rows.groupBy("township").agg(F.count("*").alias("n")).join(towns, "township")
    published = counts.select("township", F.when(F.col("k") != 3, F.col("n") + F.when(F.col("k") == 1, 2).otherwise(0)).alias("published"))
    return audits.count_parity(published, rows, "township")


@_r.query(f"""WITH {PARCELS_SQL} SELECT township, count(*) FILTER (WHERE joined) AS joined, count(*) FILTER (WHERE joined AND ordinal % 7 = 1) AS parents, count(*) FILTER (WHERE joined AND ordinal % 7 = 1 AND acres < 20) AS suspicious FROM features GROUP BY 1""")
def parent_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(~F.col("joined"), "unjoined").when(F.col("ordinal") % 7 == 1, "map_lot_parent").otherwise("map_lot")
    return audits.parent_joins(parcels(spark, sf_dir).select("township", method.alias("method"), v.number(F.col("acres_text")).alias("acres")), F.col("acres") < 20)


@_r.query(f"""WITH {PARCELS_SQL} SELECT township, count(*) AS n FROM features WHERE parcel_id IS NOT NULL GROUP BY 1""")
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a batch that is read only if each of its rows has an id and a township."""
    sound = F.col("parcel_id").isNotNull() & F.col("township").isNotNull()
    return audits.required(parcels(spark, sf_dir).select("parcel_id", "township"), sound, "a row lacks its id or township").groupBy("township").agg(F.count("*").alias("n"))
