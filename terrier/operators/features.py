"""Map elements to typed features, and features and places to one index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.functions.lots import normalize_place, slug
from terrier.functions.values import worked_out

# Tags that make an area, and ranks of places by kind.
WATER = {"natural": "water", "waterway": "riverbank", "landuse": "reservoir"}
RANKS = {"city": 60, "town": 50}
RANK_ELSE, RANK_MUNICIPALITY = 30, 100
#: Points that an area's line has at least.
LEAST_RING = 4


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (osm_id, tags, refs) with `line`, their nodes' points in the order of refs; nodes (node_id, lon, lat). A ref that no node answers is left out, as is a null one; nodes must be unique."""
    refs = ways.select("osm_id", F.posexplode("refs").alias("place", "node_id"))
    met = refs.join(nodes.select("node_id", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("point")), "node_id")
    lines = met.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("place", "point"))).alias("line")).select("osm_id", F.transform("line", lambda x: x["point"]).alias("line"))
    return ways.drop("refs").join(lines, "osm_id", "left")


def typed_features(elements: DataFrame) -> DataFrame:
    """elements (osm_id, tags, lon, lat, line): osm_id, name, kind, geometry, ring or line or point.

    An element with lon and lat is a place. One with a line of two points or more is water, closed if it isn't, if its
    tags say so and it has four; else a road, a stream or just a line. All others are left out."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    point = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    wet = F.coalesce(F.nullif(tag("water"), F.lit("")).isNotNull(), F.lit(False))
    for k, v in WATER.items():
        wet = wet | F.coalesce(tag(k) == v, F.lit(False))
    area = wet & (F.size("line") >= LEAST_RING)
    closed = F.when(F.get("line", F.lit(0)) == F.element_at("line", -1), F.col("line")).otherwise(F.concat("line", F.slice("line", 1, 1)))
    filled = lambda k: F.coalesce(tag(k), F.lit("")) != ""
    kind = F.when(point, "place").when(area, "water").when(filled("highway"), "road").when(filled("waterway"), "stream").otherwise("line")
    rows = elements.where(point | (F.size("line") >= 2))
    return rows.select(
        "osm_id", tag("name").alias("name"), tag("place").alias("place"), kind.alias("kind"), F.when(point, "Point").when(area, "Polygon").otherwise("LineString").alias("geometry"),
        F.when(point, F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))).when(area, closed).otherwise(F.col("line")).alias("points"),
    )


def _middle(box: Column) -> Column:
    return F.struct(((box["west"] + box["east"]) / 2).alias("x"), ((box["south"] + box["north"]) / 2).alias("y"))


def place_index(municipalities: DataFrame, places: DataFrame, home: str | None) -> DataFrame:
    """One index of municipalities (id, name, parts) and of the places among typed features, which belong to the municipality `home`: id, name, name_key, place_type, municipality_id, rank, centroid (the middle of its box), box. Municipalities without a shape and places without a name are left out."""
    named = F.coalesce(F.col("id"), slug(F.col("name")))
    towns = municipalities.where("parts is not null").withColumn("box", geo.shape_box(F.col("parts")))
    a = towns.select(F.concat(F.lit("muni-"), named).alias("id"), "name", normalize_place(F.col("name")).alias("name_key"), F.lit("municipality").alias("place_type"), named.alias("municipality_id"), F.lit(RANK_MUNICIPALITY).alias("rank"), _middle(F.col("box")).alias("centroid"), "box")
    rank = F.lit(RANK_ELSE)
    for k, v in RANKS.items():
        rank = F.when(F.col("place") == k, v).otherwise(rank)
    spots = places.where("name != ''").withColumn("box", geo.box(F.col("points")))
    spot_id = F.concat(F.lit("osm-"), F.coalesce(F.col("osm_id").cast("string"), slug(F.col("name"))))
    b = spots.select(spot_id.alias("id"), "name", normalize_place(F.col("name")).alias("name_key"), F.lit("populated_place").alias("place_type"), F.lit(home).alias("municipality_id"), rank.alias("rank"), _middle(F.col("box")).alias("centroid"), F.lit(None).cast(a.schema["box"].dataType).alias("box"))
    return a.unionByName(b)


def tile_cover(boxes: DataFrame, zooms: range, most: int = 256) -> DataFrame:
    """boxes (id, box in degrees): id, asked, zoom, x, y, tms_y, a row for each tile that a box meets at each of zooms. Where that would be more than `most`, the finest coarser level that has fewer stands for it, so that no box makes more rows than that. A null box has none."""
    # Dealt over as many parts as shuffles have: a small file of boxes is one task, but makes very many tiles.
    dealt = boxes.where("box is not null").repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    asked = dealt.select("id", "box", F.explode(F.sequence(F.lit(zooms.start), F.lit(zooms.stop - 1))).alias("asked"))
    tried = F.filter(F.transform(F.sequence(F.lit(0), F.col("asked")), lambda z: geo.tile_range(F.col("box"), z)), lambda r: (r["east"] - r["west"] + 1) * (r["south"] - r["north"] + 1) <= most)
    found = worked_out(asked, F.element_at(tried, -1).alias("r")).where("r.east >= r.west and r.south >= r.north")
    across = found.select("id", "asked", "r", F.explode(F.sequence("r.west", "r.east")).alias("x"))
    down = across.select("id", "asked", F.col("r.zoom").alias("zoom"), "x", F.explode(F.sequence("r.north", "r.south")).alias("y"))
    return down.select("*", (F.pow(F.lit(2.0), F.col("zoom")).cast("long") - 1 - F.col("y")).alias("tms_y"))
