"""Queries on GeoJSON, shapes of many parts, map elements, places, tiles and merged attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.functions.values import merge_attributes
from terrier.operators import features
from terrier.plans.places import LAT_SQL, LON_SQL, _lon_lat
from terrier.plans.registry import Registry
from terrier.plans.texts import _documents, _s
from terrier.plans.views import table
from terrier.sources import geojson

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of 20 features: rectangles with a hole, two rectangles as one shape, points, lines, features without geometry. A document in seven breaks off."""
    k, w, h = F.col("p_partkey"), F.col("p_size") + 1, F.col("p_partkey") % 17 + 2
    ring = lambda x, y, w, h: F.concat(*_joined([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]))
    x, o = k % 50, F.lit(0)
    coordinates = (
        F.when(k % 5 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(x, o, w, h), F.lit(","), ring(x + 0.25, o + 0.25, F.lit(0.5), F.lit(0.5)), F.lit("]}")))
        .when(k % 5 == 1, F.concat(F.lit('{"coordinates":[['), ring(x, o, w, h), F.lit("],["), ring(x - 100, o, F.lit(1), F.lit(3)), F.lit(']],"type":"MultiPolygon"}')))
        .when(k % 5 == 2, F.concat(F.lit('{"type":"Point","coordinates":['), _s(x), F.lit(", 7.5]}")))
        .when(k % 5 == 3, F.concat(F.lit('{"type":"LineString","coordinates":[['), _s(x), F.lit(",0,9],["), _s(x + 3), F.lit(",4]]}")))
        .otherwise("null")
    )
    first = F.row_number().over(Window.partitionBy(F.floor(k / 20)).orderBy(k)) == 1
    feature = F.concat(F.when(first, "").otherwise(","), F.lit('{"type":"Feature","id":"F'), _s(k), F.lit('","properties":{"name":"'), F.col("p_brand"), F.lit('","n":[1,{"a":null}]},"geometry":'), coordinates, F.lit("}"))
    docs = _documents(table(spark, sf_dir, "part"), F.floor(k / 20).cast("long"), k, feature, '{"type":"FeatureCollection","features":[')
    return docs.withColumn("text", F.when(F.col("doc_id") % 7 != 3, F.concat("text", F.lit("]}"))).otherwise(F.col("text")))


def _joined(points: list) -> list:
    """The pieces of a ring's JSON."""
    out = [F.lit("[")]
    for i, (x, y) in enumerate(points):
        out += [F.lit("[" if i == 0 else ",["), _s(x), F.lit(","), _s(y), F.lit("]")]
    return [*out, F.lit("]")]


@_r.query(r"""
    WITH p AS (
        SELECT *, p_partkey // 20 AS doc, (p_partkey % 50)::DOUBLE AS x, (p_size + 1)::DOUBLE AS w, (p_partkey % 17 + 2)::DOUBLE AS h, p_partkey % 5 AS way,
               row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS nth FROM part
    ), a AS (SELECT *, CASE way WHEN 0 THEN w * h - 0.25 WHEN 1 THEN w * h + 3 END AS area FROM p WHERE doc % 7 <> 3)
    SELECT doc AS doc_id, nth::INT AS ordinal, 'F' || p_partkey AS feature_id, p_brand AS name, CASE way WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'Point' WHEN 3 THEN 'LineString' END AS kind,
        area, regexp_replace(printf('%.6f', area / 4046.8564224), '\.?0+$', '') AS acres,
        CASE way WHEN 1 THEN x - 100 WHEN 4 THEN NULL ELSE x END AS west, CASE way WHEN 2 THEN 7.5 WHEN 4 THEN NULL ELSE 0 END::DOUBLE AS south,
        CASE way WHEN 2 THEN x WHEN 3 THEN x + 3 WHEN 4 THEN NULL ELSE x + w END AS east, CASE way WHEN 2 THEN 7.5 WHEN 3 THEN 4 WHEN 4 THEN NULL WHEN 1 THEN greatest(h, 3) ELSE h END AS north,
        CASE WHEN way < 2 THEN round(x + w / 2, 9) END AS cx, CASE WHEN way < 2 THEN round(h / 2, 9) END AS cy FROM a""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with area, acres to six places, box, and the place of their first part."""
    found = geojson.features(_collections(spark, sf_dir))
    areal = F.col("kind").isin("Polygon", "MultiPolygon")
    area, box, point = F.when(areal, geo.shape_area(F.col("parts"))), geo.shape_box(F.col("parts")), F.when(areal, geo.shape_point(F.col("parts")))
    rows = found.select("doc_id", "ordinal", "feature_id", F.get_json_object("properties", "$.name").alias("name"), "kind", area.alias("area"), box.alias("b"), point.alias("c"))
    return rows.select("doc_id", "ordinal", "feature_id", "name", "kind", "area", geo.acres_text(geo.to_acres(F.col("area"))).alias("acres"), "b.west", "b.south", "b.east", "b.north", F.round("c.x", 9).alias("cx"), F.round("c.y", 9).alias("cy"))


@_r.query("SELECT DISTINCT p_partkey // 20 AS doc_id FROM part WHERE p_partkey // 20 % 7 = 3")
def geojson_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.broken(_collections(spark, sf_dir)).select("doc_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("node_id"), (-67.0 - k / 100000).alias("lon"), (44.0 + k % 1000 / 1000).alias("lat"), "p_size", "p_brand")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways through the parts of their items, and parts of some sizes as places."""
    k = F.col("o_orderkey")
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    tags = F.when(k % 5 == 0, F.create_map(F.lit("natural"), F.lit("water"), F.lit("name"), F.col("o_orderpriority"))).when(k % 5 == 1, F.create_map(F.lit("highway"), F.lit("primary"))).when(k % 5 == 2, F.create_map(F.lit("waterway"), F.lit("stream"))).when(k % 5 == 3, F.create_map(F.lit("water"), F.lit("pond"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    ways = table(spark, sf_dir, "orders").join(refs, k == F.col("l_orderkey")).select(k.alias("osm_id"), tags.alias("tags"), F.transform("items", lambda x: x["l_partkey"]).alias("refs"))
    nodes = _nodes(spark, sf_dir)
    size = F.col("p_size")
    spots = nodes.where(size % 10 == 0).select((-F.col("node_id")).alias("osm_id"), F.create_map(F.lit("name"), F.col("p_brand"), F.lit("place"), F.when(size == 10, "city").when(size == 20, "town").otherwise("hamlet")).alias("tags"), "lon", "lat")
    return features.way_lines(ways, nodes.select("node_id", "lon", "lat")).unionByName(spots, allowMissingColumns=True)


@_r.query("""
    WITH w AS (
        SELECT o_orderkey AS osm_id, any_value(o_orderpriority) AS priority, list(l_partkey ORDER BY l_linenumber, l_partkey) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    ), l AS (
        SELECT *, len(refs) AS n, osm_id % 5 IN (0, 3) AND len(refs) >= 4 AS area FROM w WHERE len(refs) >= 2
    )
    SELECT osm_id, CASE WHEN osm_id % 5 = 0 THEN priority END AS name, CASE WHEN area THEN 'water' WHEN osm_id % 5 = 1 THEN 'road' WHEN osm_id % 5 = 2 THEN 'stream' ELSE 'line' END AS kind,
        CASE WHEN area THEN 'Polygon' ELSE 'LineString' END AS geometry, n + (area AND refs[1] <> refs[-1])::INT AS n_points,
        round(-67.0::DOUBLE - refs[1] / 100000, 6) AS first_x, round(-67.0::DOUBLE - CASE WHEN area THEN refs[1] ELSE refs[-1] END / 100000, 6) AS last_x FROM l
    UNION ALL
    SELECT -p_partkey, p_brand, 'place', 'Point', 1, round(-67.0::DOUBLE - p_partkey / 100000, 6), round(-67.0::DOUBLE - p_partkey / 100000, 6) FROM part WHERE p_size % 10 = 0""")
def osm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways joined to their nodes in order, as water (closed), roads, streams and lines, and places."""
    out = features.typed_features(_elements(spark, sf_dir))
    return out.select("osm_id", "name", "kind", "geometry", F.size("points").cast("long").alias("n_points"), F.round(F.col("points")[0]["x"], 6).alias("first_x"), F.round(F.element_at("points", -1)["x"], 6).alias("last_x"))


@_r.query(r"""
    SELECT 'muni-' || CASE WHEN n_nationkey % 3 = 0 THEN replace(lower(n_name), '_', '-') ELSE 'n' || n_nationkey END AS id, n_name AS name, replace(lower(n_name), '_', ' ') AS name_key, 'municipality' AS place_type,
        CASE WHEN n_nationkey % 3 = 0 THEN replace(lower(n_name), '_', '-') ELSE 'n' || n_nationkey END AS municipality_id, 100 AS rank, (n_nationkey * 10 + 4)::DOUBLE AS x, (n_regionkey + 4)::DOUBLE AS y, (n_nationkey * 10)::DOUBLE AS west
    FROM nation WHERE n_nationkey % 7 <> 6
    UNION ALL
    SELECT 'osm-' || (-p_partkey), p_brand, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 'populated_place', 'home', CASE p_size WHEN 10 THEN 60 WHEN 20 THEN 50 ELSE 30 END,
        round(-67.0::DOUBLE - p_partkey / 100000, 6), round(44.0::DOUBLE + p_partkey % 1000 / 1000, 6), NULL FROM part WHERE p_size % 10 = 0""")
def place_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities of a square each, some without an id, some without a shape, and the places among map elements."""
    k = F.col("n_nationkey")
    shape = F.array(F.array(geo.square(k * 10, F.col("n_regionkey"), 8.0)))
    towns = table(spark, sf_dir, "nation").select(F.when(k % 3 != 0, F.concat(F.lit("n"), _s(k))).alias("id"), F.col("n_name").alias("name"), F.when(k % 7 != 6, shape).alias("parts"))
    spots = features.typed_features(_elements(spark, sf_dir)).where("kind = 'place'")
    out = features.place_index(towns, spots, "home")
    return out.select("id", "name", "name_key", "place_type", "municipality_id", "rank", F.round("centroid.x", 6).alias("x"), F.round("centroid.y", 6).alias("y"), "box.west")


def _row_sql(lat: str) -> str:
    return f"floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * power(2.0::DOUBLE, z))::BIGINT"


@_r.query(f"""
    WITH b AS (
        SELECT c_custkey AS id, {LON_SQL} AS lon, {LAT_SQL} AS lat, CASE WHEN c_custkey % 10 = 0 THEN 3.0 ELSE 0.05 END::DOUBLE AS wide FROM customer
    ), r AS (
        SELECT id, asked, z, greatest(0, floor((lon - wide + 180) / 360 * power(2.0::DOUBLE, z))::BIGINT) AS x0, least(power(2.0::DOUBLE, z)::BIGINT - 1, floor((lon + wide + 180) / 360 * power(2.0::DOUBLE, z))::BIGINT) AS x1,
            greatest(0, {_row_sql('(lat + wide)')}) AS y0, least(power(2.0::DOUBLE, z)::BIGINT - 1, {_row_sql('(lat - wide)')}) AS y1
        FROM b, (SELECT unnest(range(8, 13))::INT AS asked) a, (SELECT unnest(range(13))::INT AS z) s WHERE z <= asked
    ), f AS (
        SELECT * FROM r WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 16 QUALIFY row_number() OVER (PARTITION BY id, asked ORDER BY z DESC) = 1
    ), g AS (SELECT id, asked, z AS zoom, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM f), h AS (SELECT id, asked, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM g)
    SELECT id, asked, zoom, x, y, power(2.0::DOUBLE, zoom)::BIGINT - 1 - y AS tms_y FROM h""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of customers' boxes at five levels, 16 a box and level at most; one box in ten is six degrees wide."""
    lon, lat = _lon_lat()
    wide = F.when(F.col("c_custkey") % 10 == 0, 3.0).otherwise(0.05)
    box = F.struct((lon - wide).alias("west"), (lat - wide).alias("south"), (lon + wide).alias("east"), (lat + wide).alias("north"))
    return features.tile_cover(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), box.alias("box")), range(8, 13), 16)


@_r.query("""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"extra":{"a":1},"k":"new"}' WHEN 1 THEN '{' || coalesce('"k":' || k || ',', '') || '"z":null}' ELSE '{' || coalesce('"k":' || k, '') || '}' END AS merged FROM e""")
def attrs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with those of a second source over them: other keys, an equal key, a null, no object at all, none on the left."""
    k = F.col("event_id")
    over = F.when(k % 3 == 0, '{"k": "new", "extra": {"a": 1}}').when(k % 3 == 1, '{"z": null}').otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", merge_attributes(F.when(k % 11 != 0, F.col("props")), over).alias("merged"))
