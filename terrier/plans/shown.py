"""Queries on how parcels are shown, picked and listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import codes, display
from terrier.functions import values as v
from terrier.operators import ownership, serving, spatial
from terrier.plans.owners import _SIMILAR_SQL, ROWS_SQL, _adjacent
from terrier.plans.places import TOUCH_SQL, touches
from terrier.plans.registry import Registry
from terrier.plans.scoring import _FLAGS, _PERCENT, _percents
from terrier.plans.views import PARCELS_SQL, parcels, table
from terrier.sources.scratch import written

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query(r"""
    WITH p AS (SELECT *, p_partkey % 4 AS way, p_partkey % 130 AS rank FROM part)
    SELECT p_partkey AS id, CASE way WHEN 0 THEN '$' || format('{:,}', p_size * 1000) WHEN 1 THEN '-$' || format('{:,}', p_size) WHEN 2 THEN 'n/a' END AS money,
        CASE way WHEN 0 THEN format('{:,}', p_size * 1000) || '.125 ac' WHEN 1 THEN p_size || ' ac' WHEN 2 THEN 'unknown' END AS acres,
        rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
        'BOX ' || p_size || ';ELM ME' AS mail, CASE WHEN way = 0 THEN p_size || ' ac softwood, 2.5 ac hardwood' WHEN way = 1 THEN 'Enrolled (acreage not parsed)' END AS woods, way = 2 AS county FROM p""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money, acres, places, mail and woods, with numbers, without any, and with text that is none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    way, text = k % 4, size.cast("string")
    money = F.when(way == 0, F.concat(text, F.lit("000.4"))).when(way == 1, F.concat(F.lit("-"), text)).when(way == 2, "n/a").otherwise("")
    acres = F.when(way == 0, F.concat(text, F.lit("000.12500"))).when(way == 1, F.concat(text, F.lit(".00001"))).when(way == 2, "unknown")
    mail = F.concat(F.lit(" BOX "), text, F.lit(",, ELM ME ,"))
    forest = F.struct(F.when(way == 0, size.cast("double")).alias("soft_acres"), F.lit(0.0).alias("mixed_acres"), F.when(way == 0, 2.5).alias("hard_acres"))
    account = F.when(way == 2, " 1234-5678").otherwise("123-5678")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), display.currency(money).alias("money"), display.acres_shown(acres).alias("acres"), display.ordinal((k % 130).cast("double") + 0.3).alias("place"), F.array_join(display.mail_lines(mail), ";").alias("mail"),
        display.woods_text(forest, way == 1).alias("woods"), display.is_county_account(account).alias("county"),
    )


@_r.query(f"""
    WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT}, r AS (
        SELECT p.parcel_id, f.ordinal, row_number() OVER (ORDER BY f.ordinal) AS i, percent, cohort, exempt, homestead, f.owner_raw, f.taxable_text, f.group_id, f.acres FROM percents p JOIN features f USING (parcel_id)
    ), t AS (
        SELECT *, [percent >= 0 AND cohort = 1, percent >= 0 AND cohort = 0, exempt AND taxable_text IS NOT NULL, owner_raw ILIKE '%State Of%' AND NOT exempt AND percent >= 0, percent < 0 AND NOT exempt, ordinal % 7 = 0, ordinal % 7 = 1,
            homestead, coalesce(abs(acres - acres * 1.2) > greatest(0.5, acres * 1.2 * 0.1), FALSE), length(owner_raw) > 5, owner_raw IS NOT NULL AND group_id IS NOT NULL] AS tests FROM r
    ), names AS (
        SELECT unnest(['ranked_improved', 'ranked_unimproved', 'book_exempt', 'public_owner', 'unranked', 'property_card', 'parent_join', 'homestead', 'acreage_discrepancy', 'searchable_owner', 'searchable_lot']) AS label, unnest(range(1, 12)) AS n
    ), picked AS (
        SELECT label, arg_min(parcel_id, ordinal) AS parcel_id FROM t JOIN names ON coalesce(tests[n], FALSE) GROUP BY 1
    ), rest AS (
        SELECT parcel_id, row_number() OVER (ORDER BY ordinal) AS turn FROM t WHERE parcel_id NOT IN (SELECT parcel_id FROM picked)
    )
    SELECT * FROM picked UNION ALL SELECT parcel_id, parcel_id FROM rest WHERE turn + (SELECT count(*) FROM picked) <= 25""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven kinds of parcels, the first of each, and the first others up to 25."""
    k, c = F.col("ordinal"), F.col
    base = parcels(spark, sf_dir).select("parcel_id", "ordinal", "taxable_text", "group_id", "acres_text")
    flags = _percents(spark, sf_dir).select("parcel_id", "percent", "cohort", "exempt", "homestead", "owner_raw")
    every = written(base.join(flags, "parcel_id"), "shown")
    ranked, acres = c("percent") >= 0, v.number(c("acres_text"))
    tests = {
        "ranked_improved": ranked & (c("cohort") == v.IMPROVED), "ranked_unimproved": ranked & (c("cohort") == v.UNIMPROVED), "book_exempt": c("exempt") & c("taxable_text").isNotNull(), "public_owner": F.upper("owner_raw").contains("STATE OF") & ~c("exempt") & ranked,
        "unranked": ~ranked & ~c("exempt"), "property_card": k % 7 == 0, "parent_join": k % 7 == 1, "homestead": c("homestead"), "acreage_discrepancy": v.acres_disagree(acres, acres * 1.2), "searchable_owner": F.length("owner_raw") > 5, "searchable_lot": c("owner_raw").isNotNull() & c("group_id").isNotNull(),
    }
    return serving.representatives(every, tests, "ordinal", "parcel_id", 25)


def _rgb_sql(stops: tuple, name: str) -> str:
    cases = " ".join(f"WHEN percent <= {high} THEN floor({a[i]} + ({b[i]} - {a[i]}) * (percent - {low}) / {float(high - low)} + 0.5)::INT" for i in (0,) for (low, a), (high, b) in zip(stops, stops[1:]))
    outside = serving.EXEMPT_COLOURS, serving.NO_COLOURS
    at = 0 if name == "fill" else 1
    return f"CASE WHEN exempt THEN {outside[0][at][0]} WHEN percent < 0 THEN {outside[1][at][0]} {cases} END AS {name}_r"


@_r.query(f"WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT} SELECT parcel_id, {_rgb_sql(serving.RAMP, 'fill')}, {_rgb_sql(serving.LINE_RAMP, 'line')}, CASE WHEN exempt THEN 154 WHEN percent < 0 THEN 176 END AS outside_b FROM percents")
def valuation_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and line of exempt, unranked and ranked parcels."""
    rows_ = _percents(spark, sf_dir)
    shown = rows_.select("parcel_id", "exempt", "percent", serving.valuation_colours(F.col("percent"), F.col("exempt")).alias("c"))
    return shown.select("parcel_id", F.col("c.fill.r").alias("fill_r"), F.col("c.line.r").alias("line_r"), F.when(F.col("exempt") | (F.col("percent") < 0), F.col("c.fill.b")).alias("outside_b"))


@_r.query(f"""WITH {PARCELS_SQL}, {_FLAGS}, {_PERCENT} SELECT count(*) AS parcels, count(owner_raw) AS with_owner, count(f.taxable_text) AS with_assessment, count(*) FILTER (WHERE percent >= 0) AS ranked, count(*) FILTER (WHERE ordinal % 7 = 0) AS card_backups
    FROM percents p JOIN features f USING (parcel_id)""")
def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _percents(spark, sf_dir).agg(F.count("*").alias("parcels"), F.count("owner_raw").alias("with_owner"), F.count("taxable_text").alias("with_assessment"), F.count_if(F.col("percent") >= 0).alias("ranked"))
    return ranks.crossJoin(parcels(spark, sf_dir).agg(F.count_if(F.col("ordinal") % 7 == 0).alias("card_backups")))


@_r.query(f"WITH {PARCELS_SQL}, {TOUCH_SQL} SELECT id, count(*) AS n, string_agg(neighbour_id, ',' ORDER BY neighbour_id) AS neighbours FROM touch GROUP BY 1")
def touch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All squares that touch do so at no distance."""
    return spatial.touch_lists(touches(spark, sf_dir)).select("id", F.size("neighbours").cast("long").alias("n"), F.array_join(F.transform("neighbours", lambda x: x["neighbour_id"]), ",").alias("neighbours"))


@_r.query(f"""
    WITH RECURSIVE {PARCELS_SQL}, {TOUCH_SQL}, {ROWS_SQL}, {_SIMILAR_SQL}, pairs AS (
        SELECT id, neighbour_id, a.owner AS oa, b.owner AS ob FROM touch JOIN rows_ a ON a.parcel_id = id JOIN rows_ b ON b.parcel_id = neighbour_id WHERE id < neighbour_id AND a.owner IS NOT NULL AND b.owner IS NOT NULL)
    SELECT id, neighbour_id, TRUE AS same_owner, FALSE AS similar_name FROM pairs WHERE oa = ob UNION ALL SELECT id, neighbour_id, FALSE, TRUE FROM pairs JOIN e ON e.a = least(oa, ob) AND e.b = greatest(oa, ob) WHERE oa <> ob""")
def adjacent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching parcels of one owner, and of two with similar names."""
    pairs = written(_adjacent(spark, sf_dir), "pairs")
    across = pairs.where("oa != ob").select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))
    none = spark.createDataFrame([], "owner string, township string, mail string")
    return ownership.adjacent_edges(pairs, ownership.similar_edges(ownership.candidate_pairs(none, across)).where("type = 'similar_name'"))


@_r.query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'WA' || lpad((p_partkey % 900)::VARCHAR, 3, '0') WHEN 1 THEN 'WAP' || lpad((p_partkey % 90)::VARCHAR, 2, '0') WHEN 2 THEN 'HA' || lpad((p_partkey % 90)::VARCHAR, 2, '0') END AS sheet FROM part""")
def map_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    m, t = F.lpad((k % 900).cast("string"), 3, "0"), F.lpad((k % 90).cast("string"), 2, "0")
    code = F.when(k % 4 == 0, F.concat(F.lit("WA"), m, F.lit("0"), (k % 7).cast("string"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("wap"), t, F.lit("04"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("HA"), t, k.cast("string"))).otherwise("ZZ9")
    return table(spark, sf_dir, "part").select(k.alias("id"), codes.map_sheet(code, F.lit(None).cast("string")).alias("sheet"))
