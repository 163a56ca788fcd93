"""Commitment books, line by line. All texts are parsed together, each as a document of its own."""

import pytest

from terrier.operators.commitments import parse_commitment_book

ZIPS = ["7 DOE, JOHN 1,000 2,000 0 04333\n01-002", "7 DOE, JOHN\n01-002\n1,000 2,000 0 04333", "7 DOE, JOHN\n01-002\n0 04333", "7 DOE, JOHN\n01-002\nAUGUSTA ME 04333", "7 DOE, JOHN\n01-002\n1,000\n2,000\n04333"]
#: The texts of all tests below.
TEXTS = [
    "7 DOE, JOHN\nPO BOX 9\n01-002\n10,000\t20,000\t0\t30,000\t435.00\nAcres 1.5\nSoft: 1 100\n01-003\n40,000\t50,000\t25,000\t90,000\t1,305.00\nAcres 2.5\nMixed: 2 200",
    "7 DOE, JOHN\nPO BOX 9\nAcres 1\n01-002\n50 other line\n02-003\nAcres 2\n99 ROE\n03-004",
    "7 DOE, JOHN\nPO BOX 9\n01-001\nAcres 1\n01-002\n01-003",
    "7 DOE, JOHN\n01-002\n01-003",
    "7 DOE, JOHN\n01-002\n02-003",
    "7 DOE, JOHN 10,000 5,000 0 15,000 217.50\n01-002",
    "7 DOE, JOHN 10,000 5,000 0 15,000\n01-002\n70,000\n80,000\n01-003",
    "7 DOE, JOHN 155,600\n01-002",
    "7 DOE, JOHN\n1,000 2,000 0 3,000\n01-002\n01-003\n4,000 5,000 0 9,000",
    "06-15-0 658 DOE, JOHN\n12 HILL\n1,000 2,000 0 3,000\nlast line",
    "5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\n02-003\n8,000\t7 W/S ELM\nLIMITED PARTNERSHIP\n2,000 0 10,000\nB12P3",
    "5,000\t6 DOE, JOHN 1,000 0 6,000\n02-003\n5 Page\n8,000\t7 W/S ELM\n2,000 0 10,000",
    "5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\nAcres 1\n5 Page\n02-003\n8,000\t7 W/S ELM\n2,000 0 10,000",
    "5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\n7 W/S ELM LLC\n02-003",
    "7 DOE, JOHN 100 200 0 300\nH7-0B4-10A\n8 ROE, ANN\nH7-0B4-10A\n9 POE, EVE 100 900 0 1,000\nG-0211-9+10",
    *ZIPS,
]
PLACES = ["12  CORN HILL\nELM HOLDINGS LLC\nPO BOX 3\n010-001\n23970\n67030\n91000"]


@pytest.fixture(scope="module")
def books(spark):
    """The rows of a text, by lot."""
    rows = {}
    for layout, texts in (("by_name", TEXTS), ("map_lot", PLACES)):
        docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string")
        for r in parse_commitment_book(docs, layout).collect():
            rows.setdefault(texts[r.doc_id], {})[r.lot] = r
    return rows.__getitem__


def test_each_lot_has_the_values_of_its_own_span(books):
    got = books("7 DOE, JOHN\nPO BOX 9\n01-002\n10,000\t20,000\t0\t30,000\t435.00\nAcres 1.5\nSoft: 1 100\n01-003\n40,000\t50,000\t25,000\t90,000\t1,305.00\nAcres 2.5\nMixed: 2 200")
    a, b = got["01-002"], got["01-003"]
    assert (a.land, a.building, a.exemption, a.total, a.tax, a.value_source) == ("10000", "20000", None, "30000", "435.00", "row")
    assert (b.land, b.building, b.exemption, b.total, b.tax, b.value_source) == ("40000", "50000", "25000", "90000", "1305.00", "row")
    assert b.forest.mixed_acres == 2 and b.forest.soft_acres == 1 and a.forest.mixed_acres is None


def test_only_lots_that_acres_are_bound_to_count(books):
    got = books("7 DOE, JOHN\nPO BOX 9\nAcres 1\n01-002\n50 other line\n02-003\nAcres 2\n99 ROE\n03-004")
    assert set(got) == {"01-002"}
    assert set(books("7 DOE, JOHN\nPO BOX 9\n01-001\nAcres 1\n01-002\n01-003")) == {"01-001", "01-002"}  # the first opens the account
    assert set(books("7 DOE, JOHN\n01-002\n01-003")) == {"01-002", "01-003"} and set(books("7 DOE, JOHN\n01-002\n02-003")) == {"01-002"}


def test_a_header_with_figures_holds_for_a_single_lot(books):
    one = books("7 DOE, JOHN 10,000 5,000 0 15,000 217.50\n01-002")["01-002"]
    assert (one.land, one.total, one.tax, one.value_source) == ("10000", "15000", "217.50", "header")
    two = books("7 DOE, JOHN 10,000 5,000 0 15,000\n01-002\n70,000\n80,000\n01-003")
    assert {(r.land, r.building, r.total, r.value_source) for r in two.values()} == {("10000", "0", "10000", "land_tail")}
    assert books("7 DOE, JOHN 155,600\n01-002")["01-002"].value_source == "land_tail"


def test_a_row_before_the_lot_counts_for_it(books):
    got = books("7 DOE, JOHN\n1,000 2,000 0 3,000\n01-002\n01-003\n4,000 5,000 0 9,000")
    assert got["01-002"].total == "3000" and got["01-003"].total == "9000"
    front = books("06-15-0 658 DOE, JOHN\n12 HILL\n1,000 2,000 0 3,000\nlast line")["06-15-0"]
    assert (front.account, front.total) == ("658", "3000")


@pytest.mark.parametrize("text", ZIPS)
def test_a_zip_is_no_total(books, text):
    r = books(text)["01-002"]
    assert (r.land, r.building, r.total) == (None, None, None) and r.confidence == 0.3


def test_a_partnership_takes_its_lot_back(books):
    got = books("5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\n02-003\n8,000\t7 W/S ELM\nLIMITED PARTNERSHIP\n2,000 0 10,000\nB12P3")
    assert (got["01-002"].account, got["02-003"].account, got["02-003"].owner, got["02-003"].total) == ("6", "7", "W/S ELM LIMITED PARTNERSHIP", "10000")
    kept = books("5,000\t6 DOE, JOHN 1,000 0 6,000\n02-003\n5 Page\n8,000\t7 W/S ELM\n2,000 0 10,000")
    assert kept["02-003"].account == "6"
    assert "02-003" not in books("5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\nAcres 1\n5 Page\n02-003\n8,000\t7 W/S ELM\n2,000 0 10,000")
    assert books("5,000\t6 DOE, JOHN 1,000 0 6,000\n01-002\n7 W/S ELM LLC\n02-003")["01-002"].account == "6"  # no land value in front


def test_owner_below_the_header_and_place(books):
    got = books("12  CORN HILL\nELM HOLDINGS LLC\nPO BOX 3\n010-001\n23970\n67030\n91000")["010-001"]
    assert (got.owner, got.owner_source, got.situs, got.total, got.confidence) == ("ELM HOLDINGS LLC", "entity-line", "CORN HILL", "91000", 0.88)


def test_grid_lots_and_equal_lots(books):
    got = books("7 DOE, JOHN 100 200 0 300\nH7-0B4-10A\n8 ROE, ANN\nH7-0B4-10A\n9 POE, EVE 100 900 0 1,000\nG-0211-9+10")
    assert got["H7-0B4-10A"].account == "7" and {"G-0211-9", "G-0211-10"} <= set(got)
