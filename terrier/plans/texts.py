"""Queries on documents, search and attributes. Documents are put together from columns, which the parsers must give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions.lots import normalize_place
from terrier.operators import commitments, parsers, serving
from terrier.plans.registry import Registry
from terrier.plans.views import table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _s(c):
    return c.cast("string")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over as many parts as shuffles have: a small file is one task, however long its texts take to parse."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _documents(rows: DataFrame, key, order, text, head: str = "") -> DataFrame:
    """One document for each key: the texts of its rows in order. Keys have a bounded number of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, so that small texts are parsed by all cores
    each = rows.select(key.alias("doc_id"), order.alias("o"), text.alias("t")).repartition(parts, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("ts"))
    return each.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("ts", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))


_UP = lambda i: f"upper(split_part(p_name, ' ', {i}))"
_NAME_SQL = f"{_UP(1)} || ', ' || {_UP(2)}"


def _name():
    return F.concat(F.upper(F.element_at(F.split("p_name", " "), 1)), F.lit(", "), F.upper(F.element_at(F.split("p_name", " "), 2)))


@_r.query(f"""
    WITH p AS (
        SELECT *, p_partkey - p_partkey % 9 // 8 AS lot_no, CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size % 9 END AS plan FROM part
    )
    SELECT p_partkey // 20 AS doc_id, (100000 + p_partkey)::VARCHAR AS property_id,
        'WA' || lpad((lot_no % 50)::VARCHAR, 3, '0') || '|' || CASE WHEN plan < 10 THEN '0' ELSE '' END || plan || '-'
            || unnest(CASE WHEN p_partkey % 4 = 0 THEN [lot_no::VARCHAR, lot_no || '.5a'] ELSE [lot_no::VARCHAR] END) AS map_key,
        {_NAME_SQL} AS owner, 'PO BOX ' || p_size || ', DANFORTH ME 04424' AS mail, (p_size * 1000)::VARCHAR || '.00' AS land,
        floor(p_retailprice)::BIGINT::VARCHAR || '.00' AS taxable, CASE WHEN p_partkey % 3 = 0 THEN '25000.00' END AS exemption,
        CASE WHEN p_partkey % 2 = 0 THEN '100.00' ELSE '33.34' END AS percent_ownership, '0.00' AS personal_property, 'DIV ' || p_brand AS division,
        CASE WHEN p_partkey % 4 = 0 THEN 'copied_full_assessment' ELSE 'single_lot' END AS allocation, 0.9::DOUBLE AS confidence
    FROM p""")
def ut_block_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some properties share map, plan and lot with the one before; some plans have three digits; a second lot has a capital at its end."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lot = k - F.floor(k % 9 / 8).cast("long")
    plan = F.when(k % 7 == 0, _s(size + 100)).otherwise(_s(size % 9))
    text = F.concat(
        F.lit("Property ID: "),
        _s(100000 + k),
        F.lit(" Percent Ownership: "),
        F.when(k % 2 == 0, "100.00").otherwise("33.34"),
        F.lit("%\nAccount ID: 12-"),
        _s(k),
        F.lit(" Land Value "),
        F.format_string("%,d.00", size * 1000),
        F.lit("\nBuilding Value 0.00\nAcres 1.10 Personal Property 0.00\nTotal Exemptions "),
        F.when(k % 3 == 0, "25,000.00").otherwise("0.00"),
        F.lit("\nTaxable Value "),
        F.format_string("%,d.00", F.floor("p_retailprice").cast("long")),
        F.lit("\nTax 7.50\n"),
        _name(),
        F.lit("\nPO BOX "),
        _s(size),
        F.lit("\nDANFORTH ME 04424\nWashington\nDIV "),
        F.col("p_brand"),
        F.lit("\nMAP WA"),
        F.lpad(_s(lot % 50), 3, "0"),
        F.lit(" PLAN "),
        plan,
        F.lit(" LOT "),
        _s(lot),
        F.when(k % 4 == 0, F.concat(F.lit(" "), _s(lot), F.lit(".5A"))).otherwise(""),
    )
    docs = _documents(table(spark, sf_dir, "part"), F.floor(k / 20).cast("long"), k, text, "VALUATION\n")
    return parsers.parse_valuation_book(docs).select("doc_id", "property_id", "map_key", "owner", "mail", "land", "taxable", "exemption", "percent_ownership", "personal_property", "division", "allocation", "confidence")


@_r.query("""
    SELECT c_custkey // 30 AS doc_id, 'Section ' || (c_custkey // 10)::VARCHAR || ' Township' AS division, (298500000 + c_custkey)::VARCHAR AS property_id,
        CASE WHEN c_custkey % 5 = 0 THEN NULL
             ELSE 'WA' || lpad((c_custkey % 50)::VARCHAR, 3, '0') || '|' || CASE WHEN c_custkey % 4 = 0 THEN '12' ELSE '0' END || (c_custkey % 7)::VARCHAR || '-' || u END AS map_key,
        '1234.5' AS acres, c_name AS owner
    FROM (SELECT *, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['-'] WHEN c_custkey % 3 = 0 THEN ['1', '2.1'] ELSE ['7'] END) AS u FROM customer WHERE c_custkey >= 30)""")
def map_index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of one digit and of three; a line in eleven is followed by one whose id is of another county. The county's ids go on from 298,500,000 to 399,999,999, those of the other county lie below 298,000,000."""
    k = F.col("c_custkey")
    head = F.when(k % 10 == 0, F.concat(F.lit("Map/Lot # Owner\nSection "), _s(F.floor(k / 10).cast("long")), F.lit(" Township, Washington\nAcreage\n"))).otherwise("")
    place = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" Plan "), F.when(k % 4 == 0, "12").otherwise(""), _s(k % 7), F.lit(" Lot "), F.when(k % 3 == 0, "1 2.1").otherwise("7")))
    other = F.when(k % 11 == 0, F.concat(F.lit("\nMap WA001 Plan 1 Lot 1 "), _s(100500000 + k), F.lit(" 5 NOBODY"))).otherwise("")
    text = F.concat(head, F.lit("Map WA"), F.lpad(_s(k % 50), 3, "0"), place, F.lit(" "), _s(298500000 + k), F.when(k % 2 == 0, "P").otherwise(""), F.lit("\t1,234.5 "), F.col("c_name"), other)
    docs = _documents(table(spark, sf_dir, "customer").where(F.floor(k / 30) > 0), F.floor(k / 30).cast("long"), k, text)
    return parsers.parse_map_index(docs, r"29[89]\d{6}|3\d{8}").select("doc_id", "division", "property_id", "map_key", "acres", "owner")


@_r.query(f"""SELECT p_partkey AS doc_id, lpad((p_size)::VARCHAR, 3, '0') || '-' || lpad((p_partkey % 900 + 1)::VARCHAR, 3, '0') AS lot, (p_partkey % 9999 + 1)::VARCHAR AS account, {_NAME_SQL} AS owner, '2023-0' || (p_size % 9 + 1) || '-12' AS as_of FROM part WHERE p_partkey % 6 <> 0""")
def card_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card in six has its owner after a line that ends the owner's."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("Sale Data\nMap Lot \t"), F.lpad(_s(size), 3, "0"), F.lit("-"), F.lpad(_s(k % 900 + 1), 3, "0"), F.lit("-000 \tAccount \t"), _s(k % 9999 + 1), F.lit(" \tLocation \tCard \t1 \tOf \t1 \t"), _s(size % 9 + 1), F.lit("/12/2023\n"), F.when(k % 6 == 0, "Previous Owner\n").otherwise("12 HIGH ST\n"), _name(), F.lit("\nDANFORTH ME 04424\nSMITH, OTHER\n"))
    return parsers.parse_cards(_spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("doc_id"), text.alias("text"))).select("doc_id", "lot", "account", "owner", "as_of")


@_r.query(f"""
    SELECT DISTINCT doc_id, owner, lot_key FROM (
        SELECT p_partkey // 25 AS doc_id, {_NAME_SQL} AS owner,
            CASE WHEN p_partkey % 3 = 0 THEN lpad(p_size::VARCHAR, 2, '0') || 'A' ELSE lpad(p_size::VARCHAR, 3, '0') END || '-'
                || unnest(CASE p_partkey % 6 WHEN 0 THEN ['001', '003'] WHEN 1 THEN ['010', '011', '012'] WHEN 2 THEN ['005-001'] WHEN 3 THEN ['067-00A'] WHEN 4 THEN ['1234'] ELSE ['004-DEA2'] END) AS lot_key
        FROM part)""")
def owner_index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are HTML, half Markdown; lots with letters, parts, ranges in either direction and of four digits; lettered maps."""
    k = F.col("p_partkey")
    lot = F.when(k % 6 == 0, "1+3").when(k % 6 == 1, F.when(k % 12 == 1, "12-10").otherwise("10-12")).when(k % 6 == 2, "5-1").when(k % 6 == 3, "67a").when(k % 6 == 4, "1234").otherwise("4 DEA2")
    sheet = F.concat(_s(F.col("p_size")), F.when(k % 3 == 0, "a").otherwise(""))
    html = F.concat(F.lit("<tr class='x'><td><b>"), _name(), F.lit("</b></td> <td>"), sheet, F.lit("</td><td>"), lot, F.lit("</td></tr>"))
    mark = F.concat(F.lit("| "), _name(), F.lit(" | "), sheet, F.lit(" | "), lot, F.lit("   |"))
    doc = F.floor(k / 25).cast("long")
    docs = _documents(table(spark, sf_dir, "part"), doc, k, F.when(doc % 2 == 0, html).otherwise(mark), "| OWNER | MAP | LOT |\n| --- | --- | --- |\n")
    return parsers.parse_owner_index(docs).select("doc_id", "owner", "lot_key")


@_r.query(f"""
    SELECT p_partkey AS doc_id, {_NAME_SQL} || CASE WHEN p_partkey % 4 = 2 THEN ' / OTHER, ANN' ELSE '' END AS owner, CASE WHEN p_partkey % 4 = 2 THEN 'BOLD, SUE' ELSE 'SELLER, SAM' END AS seller, (p_size)::VARCHAR AS map,
        (p_partkey % 900)::VARCHAR || CASE WHEN p_partkey % 4 = 1 THEN '2A' ELSE '' END AS lot, CASE WHEN p_partkey % 2 = 0 THEN '2025' ELSE '2024' END || '-03-0' || (p_size % 9 + 1) AS date
    FROM part WHERE p_partkey % 8 <> 7""")
def transfer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration in eight is of another town; half have only the date of recording, its last digit misread; forms with values below their labels, with a sub-lot, in bold, and with all figures of the property together."""
    k, size = F.col("p_partkey"), F.col("p_size")
    date = F.when(k % 2 == 0, F.concat(F.lit("Date/Time Recorded: 3/"), _s(size % 9 + 1), F.lit("/202s\n"))).otherwise(F.concat(F.lit("7. DATE OF TRANSFER (MM-DD-YYYY)\n03-0"), _s(size % 9 + 1), F.lit("-2024\n")))
    head = F.concat(F.lit("MAINE REAL ESTATE TRANSFER TAX DECLARATION\n1. County WASHINGTON\n2. Municipality "), F.when(k % 8 == 7, "ELSEWHERE").otherwise("ELMTOWN"))
    below = F.concat(F.lit("\n3. GRANTEE/PURCHASER\n3a. Last name or business name\n"), _name(), F.lit(" TRUSTEE\n3c. Federal ID\n4. GRANTOR/SELLER\n4a. Last name or business name\nSELLER, SAM PR\n4c. Federal ID\n5. PROPERTY Tax Map\n"), _s(size), F.lit("\nBlock\nLot\n"), _s(k % 900), F.when(k % 4 == 1, "\nSub-lot\n2a\n").otherwise("\nSub-lot\n0\n"))
    bold = F.concat(F.lit("\n3. GRANTEE/PURCHASER\n**"), _name(), F.lit("**\n**OTHER, ANN**\n**FEDERAL ID**\n4. GRANTOR/SELLER\n**BOLD, SUE**\n5. PROPERTY\n5a. Map\n**"), _s(size), F.lit("**\nBlock\nLot\n**"), _s(k % 900), F.lit("**\nSub-lot\n"))
    inline = F.concat(F.lit("\n3. GRANTEE/PURCHASER Last name, first name, MI; or business name "), _name(), F.lit("\n4. GRANTOR/SELLER Last name, first name, MI; or business name SELLER, SAM\n5. PROPERTY Tax Map Block Lot Sub-lot Tax maps exist "), _s(size), F.lit(" 0 "), _s(k % 900), F.lit(" 0 for property: No\n"))
    text = F.concat(head, F.when(k % 4 == 2, bold).when(k % 4 == 3, inline).otherwise(below), date, F.lit("6. CURRENT USE none of these classifications apply to the property that is described in this declaration\n"))
    return parsers.parse_transfers(_spread(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("doc_id"), text.alias("text")), "Elmtown").drop("at")


@_r.query("""SELECT p_partkey AS id, p_size::DOUBLE AS soft_acres, (p_size * 1000)::DOUBLE AS soft_value, CASE WHEN p_partkey % 2 = 0 THEN 2.5 END::DOUBLE AS mixed_acres, CASE WHEN p_partkey % 2 = 0 THEN 300 END::DOUBLE AS mixed_value, 0.0::DOUBLE AS hard_acres, 0.0::DOUBLE AS hard_value FROM part""")
def forest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Acres 3\nSoft: 1 2\nSoft: "), _s(F.col("p_size")), F.lit(" "), F.format_string("%,d", F.col("p_size") * 1000), F.when(F.col("p_partkey") % 2 == 0, "\n  Mixed: 2.5 300").otherwise(""), F.lit("\nHard: 0 0\n"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parsers.forest_lines(text).alias("f")).select("id", "f.*")


_LOT_SQL = "lpad((p_partkey % 90 + 10)::VARCHAR, 3, '0') || '-' || lpad((p_partkey // 90 % 900 + 1)::VARCHAR, 3, '0')"
_BOOK_HEAD = "Real Estate Tax Commitment Book\nAccount Name & Address Land Building Exemption Assessment\n"
_ACCOUNT_COLUMNS = ("doc_id", "account", "owner", "mail", "land", "total", "exemption", "tax", "acres", "homestead", "lot", "confidence")


def _lot():
    k = F.col("p_partkey")
    return F.concat(F.lpad(_s(k % 90 + 10), 3, "0"), F.lit("-"), F.lpad(_s(F.floor(k / 90).cast("long") % 900 + 1), 3, "0"))


def _money(c):
    return F.format_string("%,d", c.cast("long"))


def _book(spark: SparkSession, sf_dir: str, text, layout: str = "by_name") -> DataFrame:
    k = F.col("p_partkey")
    return commitments.parse_commitment_book(_documents(table(spark, sf_dir, "part"), F.floor(k / 15).cast("long"), k, text, _BOOK_HEAD), layout)


@_r.query(f"""
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 9000 + 1)::VARCHAR AS account, {_NAME_SQL} AS owner, p_size || ' HIGH ST, DANFORTH ME 04424' AS mail, (p_size * 1000)::VARCHAR AS land,
        floor(p_retailprice)::BIGINT::VARCHAR AS total, CASE WHEN p_partkey % 2 = 0 THEN '25000' END AS exemption, '14.50' AS tax, '0.76' AS acres, p_partkey % 2 = 0 AS homestead, {_LOT_SQL} AS lot,
        CASE WHEN p_size * 1000 > 1.25 * floor(p_retailprice) AND 1100 > floor(p_retailprice) OR floor(p_retailprice) > p_size * 1000 + 11100 THEN 0.75 ELSE 0.9 END::DOUBLE AS confidence
    FROM part""")
def commitment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers begin with the account; a page's totals end a block."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        _s(k % 9000 + 1), F.lit(" "), _name(), F.lit(" \t"), _money(size * 1000), F.lit(" \t1,100 \t"), F.when(k % 2 == 0, "25,000").otherwise("0"), F.lit(" \t"), _money(F.floor("p_retailprice")), F.lit(" \t14.50\nAcres \t0.76 "),
        F.when(k % 2 == 0, "19 Homestead").otherwise(""), F.lit("\n"), _s(size), F.lit(" HIGH ST\nDANFORTH ME 04424\n"), _lot(), F.lit("-000\nB5152P32 11/14/2024"), F.when(k % 5 == 0, "\n12,000 Page Totals: 3\n999-999\nLeft Over").otherwise(""),
    )
    return _book(spark, sf_dir, text).select(*_ACCOUNT_COLUMNS)


@_r.query(f"""
    WITH p AS (
        SELECT *, (p_size + 10) * 1000 AS land_value, p_partkey % 5 = 0 AND p_partkey % 4 <> 3 AS tail,
               unnest(CASE WHEN p_partkey % 5 = 0 THEN ['9', '10'] ELSE ['0'] END) AS u FROM part
    )
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 900 + 1)::VARCHAR AS account,
        CASE WHEN p_partkey % 4 = 3 THEN 'W/S ' || {_NAME_SQL} || ' LIMITED PARTNERSHIP' ELSE {_NAME_SQL} END AS owner,
        (land_value + CASE WHEN tail THEN 1100 ELSE 0 END)::VARCHAR AS land, CASE WHEN tail THEN '0' ELSE '1100' END AS building, (land_value + 1100)::VARCHAR AS total,
        CASE WHEN p_partkey % 4 = 3 THEN 'row' WHEN tail THEN 'land_tail' ELSE 'header' END AS value_source, '3182.75' AS tax, '0.46' AS acres,
        CASE WHEN p_partkey % 5 = 0 THEN 'G-0' || (p_partkey % 900 + 100) || '-' || u ELSE {_LOT_SQL} END AS lot, 0.9::DOUBLE AS confidence
    FROM p""")
def commitment_parse_land_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The land value in front of the account; partnerships whose name and figures go on below; lots on a grid with additions, each of which gets the last figure as land; a lot of the next page that no acres line binds."""
    k, land = F.col("p_partkey"), (F.col("p_size") + 10) * 1000
    figures = F.concat(F.lit(" 1,100 \t0 \t"), _money(land + 1100))
    head = F.concat(_money(land), F.lit("\t"), _s(k % 900 + 1), F.lit(" "), F.when(k % 4 == 3, F.concat(F.lit("W/S "), _name(), F.lit("\nLIMITED PARTNERSHIP\n"), figures)).otherwise(F.concat(_name(), F.lit(" \t"), figures)))
    lot = F.when(k % 5 == 0, F.concat(F.lit("G-0"), _s(k % 900 + 100), F.lit("-9+10"))).otherwise(_lot())
    text = F.concat(head, F.lit("\n106 EVERGREEN CT\nHAMPDEN ME 04444\nB2469P327 10/01/1989\n3,182.75\n0.46\tAcres\n"), lot, F.when(k % 6 == 0, "\n888-888").otherwise(""), F.lit("\n406\tPage\n160,500\tPage Totals: \t695,600 25,000"))
    return _book(spark, sf_dir, text).select("doc_id", "account", "owner", "land", "building", "total", "value_source", "tax", "acres", "lot", "confidence")


_SECOND_LOT_SQL = "'7' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad((p_partkey // 90 % 900 + 1)::VARCHAR, 3, '0')"


@_r.query(f"""
    WITH p AS (
        SELECT *, p_partkey % 6 AS way, unnest(CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN [1, 2] ELSE [1] END) AS nth, (p_size + 10) * 1000 AS value FROM part
    ), v AS (
        SELECT *, CASE way WHEN 0 THEN value * nth WHEN 1 THEN value WHEN 2 THEN value WHEN 4 THEN value WHEN 5 THEN 4000 * nth END AS land FROM p
    )
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 9000 + 1)::VARCHAR AS account, {_NAME_SQL} AS owner, 'PO BOX 5' AS mail,
        land::VARCHAR AS land, CASE way WHEN 0 THEN 500 + nth WHEN 3 THEN NULL WHEN 4 THEN 900 WHEN 5 THEN 7000 ELSE 0 END::VARCHAR AS building,
        CASE way WHEN 0 THEN land + 500 + nth WHEN 4 THEN land + 900 WHEN 5 THEN land + 7000 ELSE land END::VARCHAR AS total,
        CASE way WHEN 0 THEN 'row' WHEN 1 THEN 'land_tail' WHEN 2 THEN 'land_tail' WHEN 3 THEN 'header' WHEN 4 THEN 'row' ELSE 'columnar' END AS value_source,
        CASE way WHEN 0 THEN '3' || nth || '.50' WHEN 4 THEN '77.10' WHEN 5 THEN '1.25' END AS tax, CASE WHEN way IN (0, 1, 5) THEN nth || '.5' END AS acres,
        CASE WHEN way = 0 THEN nth ELSE NULL END::DOUBLE AS soft_acres,
        CASE WHEN way = 4 THEN 'H7-0B4-' || p_partkey WHEN nth = 1 THEN {_LOT_SQL} ELSE {_SECOND_LOT_SQL} END AS lot, CASE WHEN way = 3 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence
    FROM v""")
def commitment_parse_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with lots of their own figures: a row, a tax, acres and woods for each of two lots; one header's figures over two lots, which leave each the land value; a land value at the end of a name; a total that is a zip; a lot on a square of a grid; figures one below the other for each of two lots."""
    k, value = F.col("p_partkey"), (F.col("p_size") + 10) * 1000
    second = F.concat(F.lit("7"), F.lpad(_s(k % 90 + 10), 2, "0"), F.lit("-"), F.lpad(_s(F.floor(k / 90).cast("long") % 900 + 1), 3, "0"))
    head = F.concat(_s(k % 9000 + 1), F.lit(" "), _name())
    mail = F.lit("\nPO BOX 5\n")
    acres = lambda i: F.lit(f"Acres {i}.5\n")
    row = lambda i: F.concat(F.lit("\n"), _money(value * i), F.lit(f"\t{500 + i}\t0\t"), _money(value * i + 500 + i), F.lit(f"\t3{i}.50\nSoft: {i} 300\n"))
    below = lambda i: F.lit(f"\n{4 * i},000\n7,000\n{4 * i + 7},000\n{i}.25\n")
    text = (
        F.when(k % 6 == 0, F.concat(head, mail, acres(1), _lot(), row(1), acres(2), second, row(2)))
        .when(k % 6 == 1, F.concat(head, F.lit(" "), _money(value), F.lit(" 300 0 "), _money(value + 300), mail, acres(1), _lot(), F.lit("\n"), acres(2), second))
        .when(k % 6 == 2, F.concat(head, F.lit(" "), _money(value), mail, _lot()))
        .when(k % 6 == 3, F.concat(head, F.lit(" 2,000 1,000 0 04652"), mail, _lot()))
        .when(k % 6 == 4, F.concat(head, mail, F.lit("H7-0B4-"), _s(k), F.lit("\n"), _money(value), F.lit(" 900 0 "), _money(value + 900), F.lit(" 77.10")))
        .otherwise(F.concat(head, mail, acres(1), _lot(), below(1), acres(2), second, below(2)))
    )
    columns = ("doc_id", "account", "owner", "mail", "land", "building", "total", "value_source", "tax", "acres", F.col("forest.soft_acres").alias("soft_acres"), "lot", "confidence")
    return _book(spark, sf_dir, text).select(*columns)


@_r.query(f"""
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 900 + 1)::VARCHAR AS account, CASE WHEN p_partkey % 4 = 3 THEN 'W/S ' || {_NAME_SQL} || ' MARKETPLACE' ELSE {_NAME_SQL} END AS owner,
        ((p_size + 10) * 1000)::VARCHAR AS land, '1100' AS building, ((p_size + 10) * 1000 + 1100)::VARCHAR AS total, CASE WHEN p_partkey % 4 = 3 THEN 'row' ELSE 'header' END AS value_source, {_LOT_SQL} AS lot
    FROM part WHERE NOT (p_partkey % 4 = 3 AND p_partkey % 15 IN (0, 5))""")
def commitment_parse_partnerships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lot of a partnership stands before its header, as the last line of the account before; at the beginning of a book, and behind a page's end, there is none to take back."""
    k, land = F.col("p_partkey"), (F.col("p_size") + 10) * 1000
    figures = F.concat(F.lit(" 1,100 \t0 \t"), _money(land + 1100))
    following = F.concat(F.lpad(_s((k + 1) % 90 + 10), 3, "0"), F.lit("-"), F.lpad(_s(F.floor((k + 1) / 90).cast("long") % 900 + 1), 3, "0"))
    own = F.when(k % 4 != 3, F.concat(F.lit("\n"), _lot())).otherwise("")
    ahead = F.when((k % 4 == 2) & (k % 15 != 14), F.concat(F.lit("\n"), following)).otherwise("")
    head = F.when(k % 4 == 3, F.concat(F.lit("W/S "), _name(), F.lit("\nMARKETPLACE\n"), figures)).otherwise(F.concat(_name(), F.lit(" \t"), figures))
    text = F.concat(_money(land), F.lit("\t"), _s(k % 900 + 1), F.lit(" "), head, F.lit("\nHAMPDEN ME 04444"), own, ahead, F.when(k % 15 == 4, "\n12 Page").otherwise(""))
    return _book(spark, sf_dir, text).select("doc_id", "account", "owner", "land", "building", "total", "value_source", "lot")


@_r.query(f"""
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 9000 + 1)::VARCHAR AS account, {_NAME_SQL} AS owner, 'PO Box ' || p_size || ' Cutler ME 04626, ' || p_size || ' Cutler Road' AS mail, (p_size * 1000)::VARCHAR AS land, '1481.16' AS tax,
        lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad((p_partkey // 90 % 90 + 10)::VARCHAR, 2, '0') || '-0' AS lot FROM part""")
def commitment_parse_map_lot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lot in front of the account, the mail address behind the figures."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lot = F.concat(F.lpad(_s(k % 90 + 10), 2, "0"), F.lit("-"), F.lpad(_s(F.floor(k / 90).cast("long") % 90 + 10), 2, "0"), F.lit("-0"))
    text = F.concat(lot, F.lit(" "), _s(k % 9000 + 1), F.lit(" "), _name(), F.lit(" "), _money(size * 1000), F.lit(" 1,100 0 "), _money(size * 1000 + 1100), F.lit(" PO Box "), _s(size), F.lit(" Cutler ME 04626\n\n"), _s(size), F.lit(" Cutler Road\n1,481.16\n"))
    return _book(spark, sf_dir, text).select("doc_id", "account", "owner", "mail", "land", "tax", "lot")


@_r.query(f"""
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 9000 + 1)::VARCHAR AS account, {_NAME_SQL} AS owner,
        CASE p_partkey % 3 WHEN 2 THEN NULL ELSE ((p_size + 1) * 1000)::VARCHAR END AS land, CASE p_partkey % 3 WHEN 0 THEN '70500' WHEN 1 THEN '0' END AS building,
        CASE p_partkey % 3 WHEN 0 THEN (p_size + 1) * 1000 + 70500 WHEN 1 THEN (p_size + 1) * 1000 ELSE 16300 END::VARCHAR AS total,
        CASE p_partkey % 3 WHEN 0 THEN 'columnar' WHEN 1 THEN 'columnar_single' ELSE 'assessment_only' END AS value_source, {_LOT_SQL} AS lot, 0.9::DOUBLE AS confidence
    FROM part""")
def commitment_parse_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without figures; these stand one below the other after the lot: land and building, land alone, or a zero and the total."""
    k, land = F.col("p_partkey"), _money((F.col("p_size") + 1) * 1000)
    figures = F.when(k % 3 == 0, F.concat(land, F.lit("\n0.15\n0.00\n70,500\n0\n0"))).when(k % 3 == 1, F.concat(land, F.lit("\n0.00\n"), land, F.lit("\n0"))).otherwise("0 \t16,300")
    text = F.concat(_s(k % 9000 + 1), F.lit(" \t"), _name(), F.lit("\n266 DIXIE ROAD\nLUBEC ME 04652\n"), _lot(), F.lit("\nAcres\nSoft:\nMixed:\nHard:\n"), figures, F.lit("\nB5059P91 09/28/2023\nTotal\n755,900"))
    return _book(spark, sf_dir, text).select("doc_id", "account", "owner", "land", "building", "total", "value_source", "lot", "confidence")


@_r.query(f"""
    SELECT p_partkey // 15 AS doc_id, (p_partkey % 900 + 1)::VARCHAR AS account, CASE p_partkey % 3 WHEN 0 THEN 'SMITH & SONS OF MAINE' WHEN 1 THEN 'ELM HOLDINGS LLC' ELSE {_NAME_SQL} END AS owner,
        CASE p_partkey % 3 WHEN 2 THEN 'mail-line' ELSE 'entity-line' END AS owner_source, '23970' AS land, '67030' AS building, '91000' AS total, {_LOT_SQL} AS lot, CASE p_partkey % 3 WHEN 2 THEN 0.85 ELSE 0.88 END::DOUBLE AS confidence
    FROM part""")
def commitment_parse_map_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with the place; the owner is a line below: a body, a firm, or a person with an account in front."""
    k = F.col("p_partkey")
    owner = F.when(k % 3 == 0, "SMITH & SONS OF MAINE").when(k % 3 == 1, "ELM HOLDINGS LLC").otherwise(F.concat(F.lit("00129 "), _name()))
    text = F.concat(_s(k % 900 + 1), F.lit("  CORN HILL\n"), owner, F.lit("\n"), _lot(), F.lit("\n23970\n67030\n91000"))
    return _book(spark, sf_dir, text, "map_lot").select("doc_id", "account", "owner", "owner_source", "land", "building", "total", "lot", "confidence")


@_r.query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents""")
def place_name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_place(F.col("text")).alias("plain"))


@_r.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AS enrolled, coalesce(json_extract_string(props, '$.valuationAllocation') = 'single_lot', FALSE) AS single FROM events""")
def json_attr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "double").alias("k"), (F.try_variant_get(v, "$.k", "double") > 50).alias("enrolled"), F.coalesce(F.try_variant_get(v, "$.valuationAllocation", "string") == "single_lot", F.lit(False)).alias("single"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return serving.index_parcels(p.select(F.concat(F.lit("P"), _s(F.col("p_partkey"))).alias("id"), F.col("p_name").alias("owner_name"), F.concat(F.col("p_type"), F.lit(" St")).alias("situs"), F.concat_ws("-", _s(F.col("p_size")), _s(F.col("p_partkey"))).alias("lot"), _s(F.col("p_partkey")).alias("account")))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.select(F.concat(F.lit("n"), _s(F.col("n_nationkey"))).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), _s(F.col("n_regionkey"))).alias("municipality_id"), F.lit(30).alias("rank"))
    b = r.select(F.concat(F.lit("r"), _s(F.col("r_regionkey"))).alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("r"), _s(F.col("r_regionkey"))).alias("municipality_id"), F.lit(60).alias("rank"))
    return a.unionByName(b).withColumn("name_key", normalize_place(F.col("name")))


def _search_sql(q: str, code: str, k: int) -> str:
    tokens = q.split()
    every = lambda c: " AND ".join(f"contains({c}, '{t}')" for t in tokens) if len(tokens) > 1 else "FALSE"
    return f"""(SELECT id, label, score FROM (SELECT 'P' || p_partkey AS id, p_type || ' St' AS label,
        CASE WHEN p_partkey::VARCHAR = '{code}' THEN 100 WHEN lot = '{code}' THEN 95 WHEN starts_with(lot, '{code}') THEN 85 WHEN lower(p_type || ' St') = '{q}' THEN 75 WHEN p_name = '{q}' THEN 80 WHEN contains(lower(p_type || ' St'), '{q}') THEN 55 WHEN contains(p_name, '{q}') THEN 60 WHEN contains(lot, '{code}') THEN 50 WHEN {every('p_name')} OR {every("lower(p_type || ' St')")} THEN 40 ELSE 0 END AS score
        FROM (SELECT *, p_size || '-' || p_partkey AS lot FROM part)) WHERE score > 0 ORDER BY score DESC, label, id LIMIT {k})"""


@_r.query("SELECT 'red' AS query, * FROM " + _search_sql("red", "RED", 10) + " UNION ALL SELECT 'ring red', * FROM " + _search_sql("ring red", "RINGRED", 10) + " UNION ALL SELECT '12-', * FROM " + _search_sql("12", "12-", 10))
def search_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top tens of three queries."""
    index = _index(spark, sf_dir)
    each = [serving.search_parcels(index, q).select(F.lit(q).alias("query"), "id", "label", "score") for q in ("red", "ring red", "12-")]
    return each[0].unionByName(each[1]).unionByName(each[2])


_PLACES_SQL = "places AS (SELECT 'n' || n_nationkey AS id, n_name AS name, 30 AS rank, replace(lower(n_name), '_', ' ') AS key FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 60, lower(r_name) FROM region)"


@_r.query(f"WITH {_PLACES_SQL} SELECT id, name, CASE WHEN key = 'nation 1' THEN 100 WHEN starts_with(key, 'nation 1') THEN 80 WHEN contains(key, 'nation 1') THEN 50 WHEN contains(key, 'nation') AND contains(key, '1') THEN 40 ELSE 0 END + rank AS score FROM places WHERE contains(key, 'nation') AND contains(key, '1') ORDER BY score DESC, name LIMIT 10")
def search_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_places(_places(spark, sf_dir), "Nation_1")


@_r.query(f"WITH {_PLACES_SQL} SELECT 'parcel' AS type, id, label AS name, score FROM " + _search_sql("ar", "AR", 5) + " UNION ALL SELECT * FROM (SELECT 'place' AS type, id, name, CASE WHEN key = 'ar' THEN 100 WHEN starts_with(key, 'ar') THEN 80 ELSE 50 END + rank AS score FROM places WHERE contains(key, 'ar') ORDER BY score DESC, name LIMIT 5)")
def search_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_all(_index(spark, sf_dir), _places(spark, sf_dir), "ar")
