"""Column functions, on the cases that trap them."""

import pytest
from pyspark.sql import functions as F

from terrier.functions import geo, lots, names, owners, values
from terrier.operators import commitments, parsers


@pytest.fixture
def ev(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("text, want", [(None, None), ("", None), ("  ", 0.0), ("1,234.50", 1234.5), ("0", 0.0), ("0.00", 0.0), ("12d", None), ("Infinity", None), ("NaN", None), ("-5", -5.0), ("1e3", 1000.0)])
def test_number(ev, text, want):
    assert ev(values.number(lit(text))) == want


def test_money(ev):
    assert [ev(values.is_money(lit(x))) for x in ("99", "100", "50,000,000", "50000001", "106320.00", None, "")] == [False, True, True, False, False, False, False]
    assert ev(values.amount(lit("-5"))) is None and ev(values.amount(lit("0.00"))) == 0.0
    assert ev(values.exemption(lit("0"))) is None and ev(values.exemption(lit("25,000"))) == "25000"


def test_rounding_and_bands(ev):
    assert [ev(values.round_half_up(F.lit(x))) for x in (-2.5, 2.5, 0.49)] == [-2, 3, 0]
    assert [ev(values.acreage_band(F.lit(x).cast("double"))) for x in (-1, 0, 1.99, 2, 10, 40, 199.9, 200, None)] == [None, "lt2", "lt2", "2to10", "10to40", "40to200", "40to200", "ge200", None]
    assert ev(values.acres_disagree(F.lit(10.0), F.lit(11.0))) is False and ev(values.acres_disagree(F.lit(10.0), F.lit(11.2))) is True
    assert [ev(values.confidence_level(F.lit(x).cast("double"))) for x in (None, 0.59, 0.6, 0.85)] == ["unknown", "low", "medium", "high"]


def test_exemptions(ev):
    e = lambda *a: ev(values.fully_exempt(*map(lit, a)))
    assert e("100", "100", None, None) and not e("99", "100", None, None) and not e("5", "0", "1", "1")
    assert e("30", None, "10", "20") and not e("29", None, "10", "20") and not e("0", None, None, None)
    assert [ev(values.building_cohort(lit(x))) for x in (None, "0.00", "5", "x")] == [-1, 0, 1, -1]


def test_owners(ev):
    good, bad = ("SMITH, JOHN A", "Acme Woods LLC", "STATE OF MAINE", "DOE JOHN & JANE ET AL"), ("12 HIGH ST", "MAIN STREET", "Homestead", "0 0", "ABC", "Acres 3", "PO", None, "", "LONG LAKE HILL")
    assert all(ev(owners.is_owner(lit(x))) for x in good[:3]) and not any(ev(owners.is_owner(lit(x))) for x in bad)
    assert tuple(ev(owners.sanitize_owner(lit("SMITH, JOHN 10,000 20,000 0 30,000")))) == ("SMITH, JOHN", "10000")
    assert tuple(ev(owners.sanitize_owner(lit("SMITH, JOHN 0 0 16,300")))) == ("SMITH, JOHN", "16300")
    assert ev(owners.sanitize_owner(lit(None))) is None
    assert ev(owners.normalize_owner(lit("Acme  Woods, L.L.C."))) == "ACME WOODS LLC"
    assert ev(owners.normalize_owner(lit("Doe, John ETAL"))) == "DOE JOHN ET AL"
    assert [ev(owners.owner_kind(F.lit(x))) for x in ("UNITED STATES", "TOWN OF X", "ELM LAND TRUST", "A B CO", "DOE TRUST", "DOE JOHN", "12")] == ["federal", "municipal", "conservation", "llc", "trust", "individual", "unknown"]
    assert ev(owners.is_institution(F.lit("WOODLAND PULP LLC"))) and not ev(owners.is_institution(F.lit("WOODLAND PULPS")))
    assert ev(owners.roughly_same(lit("Smith, John A."), lit("SMITH JOHN"))) and not ev(owners.roughly_same(lit("Smith, John"), lit("Jones, Ann"))) and ev(owners.roughly_same(lit(""), lit("Jones")))


def test_lots(ev):
    assert [ev(lots.normalize_lot(lit(x))) for x in (" r1-5 ", "U16-005-a", "010.004..013-000", "-7-", "", None)] == ["0R1-005", "U16-005-A", "010-004-013", "7", None, None]
    assert ev(lots.lot_candidates(lit("3-1-24-A"))) == ["3-1-24-A", "3-1-24", "003-001-024", "3-1", "003-001", "3"]
    assert ev(lots.lot_candidates(lit("5-7")))[:3] == ["5-7", "005-007", "005-007-000"]
    assert "210" in ev(lots.lot_candidates(lit("G-0210"))) and ev(lots.lot_candidates(lit(None))) == []
    assert "003-001" in ev(lots.lot_candidates(lit("003-001-00A-2")))
    assert ev(lots.is_suffix_parent(lit("003-001-A"), lit("3-1"))) is False and ev(lots.is_suffix_parent(lit("3-1-A"), lit("3-1"))) is True and ev(lots.is_suffix_parent(lit("3-12"), lit("3-1"))) is False
    assert ev(lots.normalize_place(lit("Saint-Éloi  d'Été"))) == "saint eloi d ete" and ev(lots.slug(lit(" A & B! "))) == "a-b"


def test_names(spark):
    pairs = [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("AB", "AC"), ("", "A"), ("A", "A"), (None, "A")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(F.round(names.jaro_winkler(F.col("a"), F.col("b")), 4)).collect()]
    assert got == [0.9611, 0.8133, 0.7, 0.0, 1.0, None]
    assert names.jaro_of("AB", "AC") == pytest.approx(2 / 3)


def test_polygons(ev):
    ring = geo.square(F.lit(0.0), F.lit(0.0), 10.0)
    hole = geo.square(F.lit(1.0), F.lit(1.0), 2.0)
    assert ev(geo.polygon_area(F.array(ring, hole))) == 96 and ev(geo.polygon_length(F.array(ring, hole))) == 48
    assert tuple(ev(geo.centroid(ring))) == (5.0, 5.0) and tuple(ev(geo.vertex_mean(ring))) == (5.0, 5.0)
    assert ev(geo.compactness(F.lit(100.0), F.lit(40.0))) == pytest.approx(0.7853981633974483) and ev(geo.compactness(F.lit(0.0), F.lit(4.0))) is None
    x, y = ev(geo.project(F.lit(-69.0), F.lit(45.0)))
    assert x == pytest.approx(500000) and y == pytest.approx(4982950.4, abs=0.1)


def test_parsers(spark):
    docs = lambda t: spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    book = "Property ID: 12\nLand Value 1,000.00\nTaxable Value 900.00\nTax 1.00\nWashington\nX\nMAP WA001 PLAN 2 LOT 5 5\nProperty ID: 13\nnothing here"
    rows = parsers.parse_valuation_book(docs(book)).collect()
    assert [(r.property_id, r.map_key, r.owner, r.allocation, r.confidence) for r in rows] == [("12", "WA001|02-5", None, "copied_full_assessment", pytest.approx(0.72))]
    assert parsers.parse_cards(docs("Map Lot 1-2 Account 7 1/2/23\nPrevious Owner\nDOE, JOHN")).count() == 0
    lined = "1 DOE, JOHN 10 20 0 30\n010-001\n5 Page\n010-002\n"
    assert [r.lot for r in commitments.parse_commitment_book(docs(lined)).collect()] == ["010-001"]
    assert [r[0] for r in spark.range(1).select(parsers.us_date(F.lit("13/1/2020"))).collect()] == [None]
    assert spark.range(1).select(parsers.lot_parts(F.lit("10-17"))).first()[0] == ["10-17"]
