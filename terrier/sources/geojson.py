"""GeoJSON as features: one row each, geometry as parts of rings of points, whatever its type; text that is no GeoJSON is kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A feature with its coordinates, id and properties as they stand in the text, since their depth and keys differ.
FEATURE = "struct<type: string, id: string, properties: string, geometry: struct<type: string, coordinates: string>>"
DOCUMENT = f"struct<type: string, id: string, properties: string, geometry: struct<type: string, coordinates: string>, features: array<{FEATURE}>, coordinates: string, broken: string>"
#: By type of geometry: how many arrays its coordinates are nested in.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _parts(kind: Column, coordinates: Column) -> Column:
    """parts > rings > points: a polygon is one part, and lines and points are parts of a single ring, open or of one point. Points with fewer than two numbers make the geometry null."""
    out = F.lit(None).cast("array<array<array<array<double>>>>")
    for depth in (1, 2, 3, 4):
        nested = F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
        if depth == 1:
            nested = F.array(F.array(F.array(nested)))
        elif depth == 2:
            nested = F.array(F.array(nested))
        elif depth == 3:
            nested = F.when(kind == "Polygon", F.array(nested)).otherwise(F.transform(nested, lambda line: F.array(line)))
        out = F.when(kind.isin(*[k for k, d in DEPTH.items() if d == depth]), nested).otherwise(out)
    sound = F.forall(out, lambda part: F.forall(part, lambda ring: F.forall(ring, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())))
    points = F.transform(out, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return F.when(sound & (F.size(F.flatten(F.flatten(out))) > 0), points)


def _parsed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("json_", F.from_json(text, DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))


def _is_sound() -> Column:
    known = F.col("json_.type").isin("FeatureCollection", "Feature", *DEPTH)
    return F.coalesce(F.col("json_.broken").isNull() & known, F.lit(False))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ordinal, feature_id, properties, kind, parts) of documents that are feature collections, single features or bare geometries.

    properties is JSON text. A feature without geometry, or with one that can't be read, has null parts; of a collection
    without features, and of documents that broken() tells, there are no rows."""
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("properties"), F.struct(F.col("json_.type").alias("type"), F.col("json_.coordinates").alias("coordinates")).alias("geometry"))
    single = F.struct(*[F.col(f"json_.{c}").alias(c) for c in ("type", "id", "properties", "geometry")])
    listed = F.when(F.col("json_.type") == "FeatureCollection", F.col("json_.features")).when(F.col("json_.type") == "Feature", F.array(single)).otherwise(F.array(bare))
    each = _parsed(docs, text).where(_is_sound()).select(F.col(doc_id).alias("doc_id"), F.posexplode(listed).alias("ordinal", "f"))
    return each.select("doc_id", "ordinal", F.col("f.id").alias("feature_id"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), _parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"))


def broken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of documents whose text is no GeoJSON; a null text is none."""
    return _parsed(docs, text).where(~_is_sound()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, text) of the files under path, for features() and broken(): a document each, or with `lines` one for each line, as large collections are written so that they can be split."""
    read = spark.read.text(path, wholetext=not lines)
    at = F.col("_metadata.file_path") if not lines else F.concat_ws("#", F.col("_metadata.file_path"), F.xxhash64("value").cast("string"))
    return read.where(F.trim("value") != "").select(at.alias("doc_id"), F.col("value").alias("text"))
