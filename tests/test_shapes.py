"""GeoJSON, shapes of many parts, map elements and merged attributes, on what breaks them."""

import json

import pytest
from pyspark.sql import functions as F

from terrier.functions import geo, values
from terrier.operators import features, spatial
from terrier.sources import geojson

SQUARE = [[-69.0, 45.0], [-68.999, 45.0], [-68.999, 45.001], [-69.0, 45.001], [-69.0, 45.0]]
HOLE = [[-68.9996, 45.0004], [-68.9996, 45.0006], [-68.9994, 45.0006], [-68.9994, 45.0004], [-68.9996, 45.0004]]


def test_features_of_all_types(spark, tmp_path):
    feature = lambda kind, c, **more: {"type": "Feature", "geometry": kind and {"type": kind, "coordinates": c}, **more}
    good = [
        {"type": "FeatureCollection", "features": [feature("Polygon", [SQUARE, HOLE], id=7, properties={"a": {"b": [1]}}), feature("MultiPolygon", [[SQUARE], [HOLE]]), feature(None, None), feature("MultiLineString", [[[1, 2], [3, 4]], [[5, 6]]]), feature("MultiPoint", [[1, 2, 9], [3, 4]]), feature("Point", []), feature("Polygon", "x"), feature("Point", [1, None])]},
        feature("Point", [1.5, 2]),
        {"type": "LineString", "coordinates": [[0, 0], [3, 4]]},
        {"type": "FeatureCollection", "features": []},
    ]
    bad = ['{"type":"FeatureCollection","features":[{"type"', "", "[1,2]", '{"type":"Other"}', "null", None]
    docs = spark.createDataFrame([*enumerate(map(json.dumps, good)), *((100 + i, t) for i, t in enumerate(bad))], "doc_id long, text string")
    rows = {(r.doc_id, r.ordinal): r for r in geojson.features(docs).collect()}
    assert set(rows) == {*((0, i) for i in range(8)), (1, 0), (2, 0)}
    assert {r.doc_id for r in geojson.broken(docs).collect()} == {100 + i for i in range(len(bad))}
    shape = lambda key: [[[tuple(p) for p in ring] for ring in part] for part in rows[key].parts]
    assert shape((0, 0)) == [[list(map(tuple, SQUARE)), list(map(tuple, HOLE))]] and rows[0, 0].feature_id == "7" and json.loads(rows[0, 0].properties) == {"a": {"b": [1]}}
    assert shape((0, 1)) == [[list(map(tuple, SQUARE))], [list(map(tuple, HOLE))]]
    assert shape((0, 3)) == [[[(1, 2), (3, 4)]], [[(5, 6)]]] and shape((0, 4)) == [[[(1, 2), (3, 4)]]]
    assert shape((1, 0)) == [[[(1.5, 2)]]] and shape((2, 0)) == [[[(0, 0), (3, 4)]]]
    assert all(rows[0, i].parts is None for i in (2, 5, 6, 7))
    for i, g in enumerate(good[:2]):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(g, indent=1))
    assert geojson.features(geojson.read_geojson(spark, str(tmp_path))).count() == 9
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n\nbroken\n")
    lined = geojson.read_geojson(spark, str(tmp_path / "lines"), lines=True)
    assert geojson.features(lined).count() == 10 and geojson.broken(lined).count() == 1


def test_acres_of_shapes_of_many_parts(spark):
    point = lambda p: F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))
    ring = lambda ps: F.array(*map(point, ps))
    acres = lambda *parts: geo.to_acres(geo.shape_area(geo.project_shape(F.array(*[F.array(*map(ring, p)) for p in parts]))))
    row = spark.range(1).select(acres([SQUARE]).alias("whole"), acres([HOLE]).alias("hole"), acres([SQUARE, HOLE]).alias("with_hole"), acres([SQUARE], [HOLE]).alias("both")).first()
    assert row.whole == pytest.approx(111_140 * 0.001 * 78_850 * 0.001 / 4046.8564224, rel=2e-3)
    assert row.with_hole == pytest.approx(row.whole - row.hole) and row.both == pytest.approx(row.whole + row.hole)
    texts = [spark.range(1).select(geo.acres_text(F.lit(x).cast("double"))).first()[0] for x in (1.5, 12.0, 100.0, 0.1234567, 1e-9, 0.0, -1.0, None, float("nan"))]
    assert texts == ["1.5", "12", "100", "0.123457", "0", None, None, None, None]


def test_ways_follow_their_refs(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 6)], "node_id long, lon double, lat double")
    ways = spark.createDataFrame([(1, {"natural": "water"}, [3, 1, 2, 3]), (2, {"natural": "water"}, [3, 1, 2, 4]), (3, {"water": "pond"}, [3, 1, 2]), (4, {"highway": "x"}, [5, 99, None, 4]), (5, {"waterway": "x"}, [1, 99]), (6, None, []), (7, {"waterway": "riverbank", "highway": ""}, [5, 4, 3, 2])], "osm_id long, tags map<string, string>, refs array<long>")
    places = spark.createDataFrame([(8, {"name": "Ély  Town", "place": "town"}, 1.0, 2.0), (9, {"place": "city"}, 1.0, 2.0), (10, {"name": "Half"}, 1.0, None)], "osm_id long, tags map<string, string>, lon double, lat double")
    found = features.typed_features(features.way_lines(ways, nodes).unionByName(places, allowMissingColumns=True))
    got = {r.osm_id: (r.kind, r.geometry, [int(p.x) for p in r.points]) for r in found.collect()}
    assert got == {1: ("water", "Polygon", [3, 1, 2, 3]), 2: ("water", "Polygon", [3, 1, 2, 4, 3]), 3: ("line", "LineString", [3, 1, 2]), 4: ("road", "LineString", [5, 4]), 7: ("water", "Polygon", [5, 4, 3, 2, 5]), 8: ("place", "Point", [1]), 9: ("place", "Point", [1])}
    none = spark.createDataFrame([], "id string, name string, parts array<array<array<struct<x: double, y: double>>>>")
    (one,) = features.place_index(none, found.where("kind = 'place'"), "home").collect()
    assert (one.id, one.name_key, one.rank, one.municipality_id, one.centroid.y, one.box) == ("osm-8", "ely town", 50, "home", 2.0, None)


def test_tiles_of_large_boxes_come_from_coarser_levels(spark):
    boxes = spark.createDataFrame([(1, (-180.0, -85.0, 179.999, 85.0)), (2, (-67.1, 45.0, -67.1, 45.0)), (3, (10.0, 5.0, 9.0, 6.0)), (4, None)], "id long, box struct<west: double, south: double, east: double, north: double>")
    rows = features.tile_cover(boxes, range(0, 4), 4).collect()
    assert {(r.asked, r.zoom) for r in rows if r.id == 1} == {(0, 0), (1, 1), (2, 1), (3, 1)} and sum(r.id == 1 for r in rows) == 13
    assert [(r.zoom, r.x, r.y, r.tms_y) for r in sorted(rows, key=lambda r: r.asked) if r.id == 2] == [(0, 0, 0, 0), (1, 0, 0, 1), (2, 1, 1, 2), (3, 2, 2, 5)]
    assert {r.id for r in rows} <= {1, 2, 3}


def test_attributes_are_merged_right_over_left(spark):
    cases = [('{"b":1,"a":{"x":1,"y":2}}', '{"a":{"z":null}}', '{"a":{"z":null},"b":1}'), (None, '{"a":"1"}', '{"a":"1"}'), ('{"a":1}', None, '{"a":1}'), ("oops", "[]", "{}"), ('{"a":1.50}', '{"a":null}', '{"a":null}'), ('{"é":"\\"q"}', "{}", '{"é":"\\"q"}')]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(values.merge_attributes(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in cases]


def test_touching_measures_no_rings_that_share_a_corner(spark, monkeypatch):
    """Rings with a corner in common are 0 apart as they stand; those without one are measured, and a corner that is no number is shared with none."""
    measure, sent = geo.min_ring_distance, []
    monkeypatch.setattr(geo, "min_ring_distance", lambda a, b: sent.append(True) or measure(a, b) + F.raise_error("measured"))
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 100.0, 100.0)], "id string, x double, y double")
    squares = lambda df: df.select("id", geo.square(F.col("x"), F.col("y"), 100.0).alias("ring"))
    got = {(r.id, r.neighbour_id): r.distance for r in spatial.touching(squares(rows)).collect()}
    assert got == {(i, j): 0.0 for i in "abc" for j in "abc" if i != j} and sent
    monkeypatch.undo()
    more = spark.createDataFrame([("d", -101.5, 0.0), ("e", 50.0, -100.0)], "id string, x double, y double")
    odd = spark.createDataFrame([(i, [(0.0, 0.0), (float("nan"), 1.0), (0.0, 0.0)]) for i in "mn"], "id string, ring array<struct<x: double, y: double>>")
    got = {(r.id, r.neighbour_id): r.distance for r in spatial.touching(squares(rows.unionByName(more)).unionByName(odd)).collect()}
    want = {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 0.0, ("a", "d"): 1.5, ("a", "e"): 0.0, ("b", "e"): 0.0}
    assert {k: v for k, v in got.items() if k[0] < k[1]} == want and len(got) == 2 * len(want)


def test_few_that_ask_meet_each_point_once(spark, monkeypatch):
    """Where only some ask, all points used to be dealt to nine cells each; the k nearest are the same, ties included."""
    rows = [(i, float(i % 40) * 10, float(i // 40) * 10, i % 2 == 0, i % 50 == 0) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, x double, y double, side boolean, asks boolean")
    dealt, few = [], spatial._nearest_of_few
    monkeypatch.setattr(spatial, "_nearest_of_few", lambda *a: dealt.append(1) or few(*a))
    got = {(r.id, r["rank"]): (r.neighbour_id, r.distance) for r in spatial.nearest(df, 7, part="side", asks="asks").collect()}
    want = {}
    for i, x, y, s, _ in (r for r in rows if r[4]):
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b, t, _ in rows if t == s and j != i)[:7]
        want |= {(i, at + 1): (j, pytest.approx(d)) for at, (d, j) in enumerate(near)}
    assert got == want and dealt
