"""Joins, scores and graph operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.operators import linkage, ownership, peers, ranks, spatial
from terrier.operators.components import connected_components


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)] + [(200, i) for i in range(201, 260)]
    parent = {n: n for pair in links for n in pair if n is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    linked = {n for a, b in links if a is not None and a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest(spark, k):
    r = random.Random(k)
    rows = [(i, float(r.choice([r.random() * 10, 500 + r.random()])), float(r.randrange(5)), i % 2) for i in range(40)] + [(90, 0.0, 0.0, 7), (91, None, 1.0, 0), (92, 3.0, 3.0, 0), (93, 3.0, 3.0, 0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, side int")
    got = {}
    for x in spatial.nearest(df, k=k, part="side").collect():
        got.setdefault(x.id, {})[x["rank"]] = x.neighbour_id
    known = [p for p in rows if p[1] is not None]
    for i, x, y, s in known:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b, t in known if j != i and s == t)[:k]
        assert [got.get(i, {})[n] for n in sorted(got.get(i, {}))] == [j for _, j in near]


def test_nearest_in_a_town_with_points_far_out_and_many_at_one_place(spark):
    r = random.Random(9)
    rows = [(i, r.random() * 10, r.random() * 10) for i in range(300)] + [(i, 4.0, 4.0) for i in range(300, 340)] + [(340, 1e5, -1e5), (341, -3e4, 2e4)]
    got = {}
    for x in spatial.nearest(spark.createDataFrame(rows, "id long, x double, y double"), k=3).collect():
        got.setdefault(x.id, {})[x["rank"]] = x.neighbour_id
    for i, x, y in rows:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in rows if j != i)[:3]
        assert [got[i][n] for n in (1, 2, 3)] == [j for _, j in near]


def test_touching(spark):
    corners = {"a": (0, 0), "b": (100, 0), "corner": (100, 100), "near": (-101.9, 0), "far": (0, -102.1), "inside": (10, 10)}
    df = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in corners.items()], "id string, x double, y double").select("id", geo.square(F.col("x"), F.col("y"), 100.0).alias("ring"))
    got = {(r.id, r.neighbour_id): round(r.distance, 6) for r in spatial.touching(df).collect()}
    assert got[("a", "b")] == got[("b", "a")] == 0 and got[("a", "corner")] == 0 and got[("a", "near")] == 1.9
    assert ("a", "far") not in got and got[("a", "inside")] == 0
    assert all((j, i) in got for i, j in got)


def test_small_groups_are_not_scored(spark):
    rows = [("a", float(x)) for x in range(12)] + [("b", 1.0)] * 11 + [("c", 5.0)] * 12 + [("a", None)]
    got = peers.robust_scores(spark.createDataFrame(rows, "g string, v double"), {"p": ("v", ["g"])}).collect()
    a, b, c = ([r for r in got if r.g == g] for g in "abc")
    assert {r.p_percentile for r in a if r.v is not None} == {i / 12 for i in range(12)} and all(r.p_n == 12 for r in a)
    assert all(r.p_percentile is None and r.p_mad is None and r.p_expected == 1 for r in b)
    assert all(r.p_mad is None and r.p_repeated and r.p_percentile == 0 for r in c)


def test_ranks_and_medians_of_all_sorts_of_values(spark):
    r = random.Random(5)
    inf = float("inf")
    values = [0.0, -1.0, -1000.0, -999.9999999, 999.9999999, 1000.0, 1e300, -1e300, 1e-300, inf, -inf, 12.5, 12.5, 12.5] + [r.uniform(-2000, 2000) for _ in range(200)] + [float(r.randrange(95, 105)) for _ in range(60)]
    values += [5e-324, -5e-324, 1e-310, -1e-301, 1.7e308] + [20240000.0 + r.randrange(1300) for _ in range(200)]
    rows = [(r.choice(["a", "b", None]), v) for v in values]
    counts = ranks.value_counts(spark.createDataFrame([*rows, ("a", None), ("c", None)], "g string, v double"), ["g"], "v")
    places = ranks.placed(counts, ["g"])
    for x in places.collect():
        group = [v for g, v in rows if g == x.g]
        assert (x.n, x.below, x.total) == (group.count(x.value), sum(v < x.value for v in group), len(group))
    mids = {x.g: (x.low, x.high) for x in ranks.middles(places, ["g"]).collect()}
    ordered = {g: sorted(v for h, v in rows if h == g) for g in ("a", "b", None)}
    assert mids == {g: (v[(len(v) - 1) // 2], v[len(v) // 2]) for g, v in ordered.items()}


def test_average_rank_percent(spark):
    rows = [(1, "x", 1.0), (2, "x", 2.0), (3, "x", 2.0), (4, "x", 3.0), (5, "y", 9.0), (6, "y", None)]
    got = {r.id: r.pct for r in peers.average_rank_percent(spark.createDataFrame(rows, "id long, c string, v double"), ["c"], "v", "pct").collect()}
    assert got == {1: 0, 2: 50, 3: 50, 4: 100, 5: 50, 6: -1}


def test_ladder_takes_parents_but_no_siblings(spark):
    tax = spark.createDataFrame([("t1", "29070", "3-1-24", "DOE, JOHN", "500", 0.9, 1), ("t2", "29070", "3-1-25", "ROE, ANN", None, 0.8, 2), ("t3", "29070", "7-7", "12 HIGH ST", "500", 0.9, 3)], "tax_id string, geocode string, tax_lot string, owner string, total string, confidence double, ordinal int")
    geometry = spark.createDataFrame([("g1", "29070", "003-001-024"), ("g2", "29070", "3-1-24-A"), ("g3", "29070", "3-1-25-B"), ("g4", "29070", "3-1-26"), ("g5", "29070", "7-7"), ("g6", "29070", None)], "id string, geocode string, lot string")
    got = {r.id: (r.tax_id, r.method, r.join_confidence) for r in linkage.join_by_ladder(geometry, tax).collect()}
    assert got == {"g1": ("t1", "map_lot", 0.9), "g2": ("t1", "map_lot_parent", 0.9), "g3": ("t2", "map_lot_parent", 0.55), "g4": (None, "unjoined", None), "g5": (None, "unjoined", None), "g6": (None, "unjoined", None)}


def test_similar_names(spark):
    rows = spark.createDataFrame([("DOE JOHN", "T", None), ("JOHN DOE", "T", None), ("STATE OF MAINE", "T", None), ("STATE OF MAINE DOT", "T", None), ("SMITH MARGARET", "U", "M"), ("SMITH MARGARETA", "V", "M")], "owner string, township string, mail string")
    none = spark.createDataFrame([], "a string, b string")
    got = {(r.a, r.b): r.type for r in ownership.similar_edges(ownership.candidate_pairs(rows, none)).collect()}
    assert got == {("DOE JOHN", "JOHN DOE"): "similar_name", ("STATE OF MAINE", "STATE OF MAINE DOT"): "possible_related", ("SMITH MARGARET", "SMITH MARGARETA"): "similar_name"}
    assert [tuple(r) for r in ownership.agency_edges(rows).collect()] == [("STATE OF MAINE", "STATE OF MAINE DOT")]


def test_entities_read_their_rows_once(spark, monkeypatch):
    """All sums, shares and spellings come of one table of sums; each used to parse every parcel again."""
    read = []
    keep = ownership.written
    monkeypatch.setattr(ownership, "written", lambda df, name: read.append(name) or keep(df, name))
    rows = spark.createDataFrame([("DOE", "Doe", "T", 1.0, 5.0, 3), ("DOE", "doe", "T", 2.0, None, 1), ("DOE", "Doe", "U", None, 5.0, 2), ("ROE", "Roe", None, 1.0, 1.0, 5), (None, None, "T", 1.0, 4.0, 4)], "owner string, owner_raw string, township string, acres double, taxable double, ordinal int")
    out = ownership.entities(rows)
    got = {r.owner: (r.examples, r.parcels, r.acres, r.taxable, r.townships, r.max_town_share, r.acre_share) for r in out.collect()}
    assert got == {"DOE": ("doe;Doe", 3, 3.0, 10.0, 2, 0.75, 0.6), "ROE": ("Roe", 1, 1.0, 1.0, 0, None, 0.2)}
    assert read == ["held"] and "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lags_make_no_table_of_counts_a_pair(spark):
    rows = spark.createDataFrame([("a", 1.0, 9.0), ("b", 4.0, None), ("c", 2.0, 1.0), ("d", 10.0, 3.0), ("e", None, 5.0)], "parcel_id string, taxable double, taxable_per_acre double").selectExpr("*", "false as unjoined", "'single_lot' as allocation")
    near = spark.createDataFrame([("a", x) for x in "bcd"] + [("b", "a"), ("b", "d"), ("b", "e"), ("c", "e"), ("d", "b")], "id string, neighbour_id string")
    out = spatial.lags(rows, near)
    got = {r.parcel_id: (r.lag_taxable, r.lag_per_acre, r.lag_n, r.lag_residual) for r in out.collect()}
    assert got == {"a": (4.0, 2.0, 3, -3.0), "b": (5.5, 6.0, 2, -1.5), "c": (None, None, 0, None), "d": (4.0, None, 1, 6.0), "e": (None, None, 0, None)}
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
