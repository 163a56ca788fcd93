"""Queries on geometry and neighbours, over the lattice of parcels and scattered customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import geo
from terrier.functions.owners import normalize_mail, normalize_owner
from terrier.functions.values import worked_out
from terrier.operators import peers, spatial
from terrier.plans.registry import Registry
from terrier.plans.scoring import features
from terrier.plans.views import PARCELS_SQL, SIDE, owners, parcels, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

LON_SQL, LAT_SQL = "(-67.5 + (c_custkey * 7919 % 10007) / 10007.0)", "(44.8 + (c_custkey * 104729 % 10009) / 20018.0)"


def _lon_lat():
    k = F.col("c_custkey")
    return -67.5 + (k * 7919 % 10007) / 10007.0, 44.8 + (k * 104729 % 10009) / 20018.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scattered over 100 km by hashes of their number."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 100003).cast("double").alias("x"), (k * 104729 % 100019).cast("double").alias("y"), (F.col("c_nationkey") % 2 == 0).alias("even"))


_POINTS_SQL = "points AS (SELECT c_custkey AS id, (c_custkey * 7919 % 100003)::DOUBLE AS x, (c_custkey * 104729 % 100019)::DOUBLE AS y, c_nationkey % 2 = 0 AS even FROM customer)"


def lattice(rows: DataFrame, *known: str) -> DataFrame:
    """The squares of parcels (parcel_id, gx, gy), with the columns that are to be `known` of either end of a touch."""
    more = [F.struct(*known).alias("known")] if known else []
    return rows.select(F.col("parcel_id").alias("id"), geo.square(F.col("gx") * SIDE, F.col("gy") * SIDE, SIDE).alias("ring"), *more)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(parcels(spark, sf_dir))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.touching(shapes(spark, sf_dir))


TOUCH_SQL = """touch AS (
    SELECT a.parcel_id AS id, b.parcel_id AS neighbour_id FROM features a JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON TRUE JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON TRUE
    JOIN features b ON b.gx = a.gx + dx AND b.gy = a.gy + dy WHERE a.parcel_id <> b.parcel_id)"""


@_r.query(f"""WITH p AS (SELECT c_custkey AS id, {LON_SQL} AS lon, {LAT_SQL} AS lat FROM customer), k AS (SELECT 1 / 298.257222101 AS f), e AS (SELECT f * (2 - f) AS e2 FROM k), e3 AS (SELECT e2, e2 / (1 - e2) AS ep FROM e),
    q AS (SELECT id, radians(lat) AS ph, radians(lon + 69) * cos(radians(lat)) AS a, e2, ep FROM p, e3),
    r AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(ph) * sin(ph)) AS n, tan(ph) * tan(ph) AS t, ep * cos(ph) * cos(ph) AS c,
        6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * ph - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * ph) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * ph) - (35 * e2 * e2 * e2 / 3072) * sin(6 * ph)) AS m FROM q)
    SELECT id, round(0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) + 500000, 4) AS x,
        round(0.9996 * (m + n * tan(ph) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)), 4) AS y FROM r""")
def utm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _lon_lat()
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.project(lon, lat).alias("p"))
    return out.select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@_r.query(f"""SELECT c_custkey AS id, round(sqrt(power(({LON_SQL} + 67) * {geo.METRES_LON!r}, 2) + power(({LAT_SQL} - 45) * {geo.METRES_LAT!r}, 2)), 4) AS metres FROM customer""")
def planar_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _lon_lat()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(geo.metres_apart(lon, lat, F.lit(-67.0), F.lit(45.0)), 4).alias("metres"))


@_r.query("""WITH s AS (SELECT p_partkey AS id, (p_size + 1)::DOUBLE AS w, (p_partkey % 17 + 2)::DOUBLE AS h FROM part)
    SELECT id, w * h - 0.25 AS area, 2 * (w + h) + 2 AS perimeter, round(4 * pi() * (w * h - 0.25) / power(2 * (w + h) + 2, 2), 9) AS compactness, round(id % 50 + w / 2, 9) AS cx, round(h / 2, 9) AS cy, round((w * h - 0.25) / 4046.8564224, 12) AS acres, (id % 50 + w)::DOUBLE AS east FROM s""")
def polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with a hole of half a unit."""
    w, h, x = (F.col("p_size") + 1).cast("double"), (F.col("p_partkey") % 17 + 2).cast("double"), (F.col("p_partkey") % 50).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    o = F.lit(0.0)
    outer = F.array(point(x, o), point(x + w, o), point(x + w, h), point(x, h), point(x, o))
    hole = geo.square(x + 0.25, o + 0.25, 0.5)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(outer, hole).alias("rings"))
    rows = rows.select("id", geo.polygon_area(F.col("rings")).alias("area"), geo.polygon_length(F.col("rings")).alias("perimeter"), geo.centroid(F.col("rings")[0]).alias("c"), geo.box(F.col("rings")[0]).alias("b"))
    return rows.select("id", "area", "perimeter", F.round(geo.compactness(F.col("area"), F.col("perimeter")), 9).alias("compactness"), F.round("c.x", 9).alias("cx"), F.round("c.y", 9).alias("cy"), F.round(geo.to_acres(F.col("area")), 12).alias("acres"), F.col("b.east").alias("east"))


@_r.query(f"""SELECT c_custkey AS id, floor(({LON_SQL} + 180) / 360 * 4096)::BIGINT AS x, floor((1 - ln(tan(radians({LAT_SQL})) + 1 / cos(radians({LAT_SQL}))) / pi()) / 2 * 4096)::BIGINT AS y,
    (4095 - floor((1 - ln(tan(radians({LAT_SQL})) + 1 / cos(radians({LAT_SQL}))) / pi()) / 2 * 4096))::BIGINT AS tms_y FROM customer""")
def tile_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _lon_lat()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.tile(lon, lat, 12).alias("t")).select("id", "t.*")


@_r.query("""SELECT c_nationkey AS nation, min(c_custkey * 7919 % 100003)::DOUBLE - 5.0 AS west, min(c_custkey * 104729 % 100019)::DOUBLE - 5.0 AS south, max(c_custkey * 7919 % 100003)::DOUBLE + 5.0 AS east, max(c_custkey * 104729 % 100019)::DOUBLE + 5.0 AS north,
    (min(c_custkey * 7919 % 100003) + max(c_custkey * 7919 % 100003)) / 2.0::DOUBLE AS mid_x FROM customer GROUP BY 1""")
def collection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("id") == F.col("c_custkey"))
    return p.groupBy(F.col("c_nationkey").alias("nation")).agg((F.min("x") - 5).alias("west"), (F.min("y") - 5).alias("south"), (F.max("x") + 5).alias("east"), (F.max("y") + 5).alias("north"), ((F.min("x") + F.max("x")) / 2).alias("mid_x"))


_KNN_SQL = f"""{_POINTS_SQL}, pairs AS (
    SELECT a.id, b.id AS neighbour_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance FROM points a JOIN points b ON a.id <> b.id
), knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS rank FROM pairs QUALIFY rank <= 25)"""


@_r.query(f"WITH {_KNN_SQL} SELECT id, neighbour_id, round(distance, 6) AS distance, rank::INT AS rank FROM knn")
def spatial_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(points(spark, sf_dir)).select("id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


@_r.query(f"WITH {_KNN_SQL} SELECT id, round(distance, 6) AS distance FROM knn WHERE rank = 1 ORDER BY distance DESC, id LIMIT 25")
def most_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = spatial.nearest(points(spark, sf_dir), k=1)
    return first.orderBy(F.col("distance").desc(), "id").limit(25).select("id", F.round("distance", 6).alias("distance"))


@_r.query(f"""WITH {_POINTS_SQL}, v AS (SELECT c_custkey AS id, floor(c_acctbal + 1000)::DOUBLE AS t FROM customer), pairs AS (
    SELECT a.id, b.id AS neighbour_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance FROM points a JOIN points b ON a.id <> b.id AND a.even = b.even
), knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS rank FROM pairs QUALIFY rank <= 25),
    j AS (SELECT knn.id, o.t AS own, n.t FROM knn JOIN v o ON o.id = knn.id JOIN v n ON n.id = neighbour_id),
    m AS (SELECT id, own, count(*) AS n, median(t) AS expected, count(*) FILTER (WHERE t < own) / count(*) AS percentile, median(ln(1 + greatest(0, t))) AS mid FROM j GROUP BY 1, 2),
    d AS (SELECT j.id, median(abs(ln(1 + greatest(0, t)) - mid)) AS spread FROM j JOIN m USING (id) GROUP BY 1)
    SELECT 'C' || id AS parcel_id, n AS knn_n, expected AS knn_expected, own - expected AS knn_residual, percentile AS knn_percentile, CASE WHEN spread > 0 THEN round(0.6745 * (ln(1 + greatest(0, own)) - mid) / spread, 7) END AS knn_mad FROM m JOIN d USING (id)""")
def peer_scores_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances against those of the 25 nearest of the same half of nations."""
    name = F.concat(F.lit("C"), F.col("id").cast("string"))
    pool = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("parcel_id"), (F.col("c_nationkey") % 2 == 0).alias("vacant"), F.floor(F.col("c_acctbal") + 1000).cast("double").alias("taxable"), F.lit(False).alias("unjoined"), F.lit("single_lot").alias("allocation"))
    near = spatial.nearest(points(spark, sf_dir), part="even").select(name.alias("parcel_id"), F.concat(F.lit("C"), F.col("neighbour_id").cast("string")).alias("neighbour_id"))
    return peers.knn_scores(pool, near).select("parcel_id", "knn_n", "knn_expected", "knn_residual", "knn_percentile", F.round("knn_mad", 7).alias("knn_mad"))


@_r.query(f"WITH {PARCELS_SQL}, {TOUCH_SQL} SELECT id, neighbour_id, 0.0::DOUBLE AS distance FROM touch")
def touch_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return touches(spark, sf_dir)


@_r.query(f"""WITH {PARCELS_SQL}, {TOUCH_SQL}, e AS (SELECT * FROM features WHERE NOT unjoined AND allocation <> 'copied_full_assessment'), m AS (
    SELECT t.id, median(e.taxable) AS lt, median(e.taxable_per_acre) AS lv, count(*) AS n FROM touch t JOIN e ON e.parcel_id = t.neighbour_id GROUP BY 1)
    SELECT f.parcel_id, lt AS lag_taxable, lv AS lag_per_acre, coalesce(n, 0) AS lag_n, e.taxable - lt AS lag_residual FROM features f LEFT JOIN m ON m.id = f.parcel_id LEFT JOIN e ON e.parcel_id = f.parcel_id""")
def spatial_lag_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.lags(features(spark, sf_dir), touches(spark, sf_dir))


@_r.query(f"""WITH {PARCELS_SQL}, {TOUCH_SQL} SELECT count(*) AS parcels, count(*) FILTER (WHERE n = 8) AS inner_parcels, count(*) FILTER (WHERE n < 4) AS corner_parcels, max(n) AS most FROM (SELECT id, count(*) AS n FROM touch GROUP BY 1)""")
def spatial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = touches(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("parcels"), F.count_if(F.col("n") == 8).alias("inner_parcels"), F.count_if(F.col("n") < 4).alias("corner_parcels"), F.max("n").alias("most"))


OWNER_NORM_SQL = r"trim(regexp_replace(regexp_replace(upper(regexp_replace(owner_raw, 'L\.L\.C\.', 'LLC')), '[^A-Z0-9_\s&]', ' ', 'g'), '\s+', ' ', 'g'))"


def owned(spark: SparkSession, sf_dir: str, mail: bool = True) -> DataFrame:
    """Parcels with the names of owner and, if wanted, mail, which are worked out once an owner, not once a parcel. Owners are dealt over all tasks first: their table may be one small file."""
    names = [normalize_owner(F.col("owner_raw")).alias("owner")] + ([normalize_mail(F.col("mail_raw")).alias("mail")] if mail else [])
    named = worked_out(owners(spark, sf_dir).repartition("custkey"), *names)
    return features(spark, sf_dir, named)


@_r.query(f"""WITH RECURSIVE {PARCELS_SQL}, {TOUCH_SQL}, o AS (SELECT parcel_id, {OWNER_NORM_SQL} AS owner FROM features WHERE owner_raw IS NOT NULL),
    links AS (SELECT id, neighbour_id FROM touch JOIN o a ON a.parcel_id = id JOIN o b ON b.parcel_id = neighbour_id WHERE a.owner = b.owner),
    walk AS (SELECT parcel_id AS id, parcel_id AS seen FROM o UNION SELECT walk.id, links.neighbour_id FROM walk JOIN links ON links.id = walk.seen)
    SELECT o.parcel_id, owner, min(seen) AS component FROM o JOIN walk ON walk.id = o.parcel_id GROUP BY 1, 2""")
def contiguous_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(owned(spark, sf_dir), touches(spark, sf_dir))




@_r.query(f"""WITH {_KNN_SQL}, v AS (SELECT c_custkey AS id, floor(c_acctbal + 1000)::DOUBLE AS t, c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AS ok FROM customer),
    m AS (SELECT knn.id, median(v.t) AS lt, count(*) AS n FROM knn JOIN v ON v.id = neighbour_id WHERE ok GROUP BY 1)
    SELECT v.id AS parcel_id, lt AS lag_taxable, coalesce(n, 0) AS lag_n, CASE WHEN ok THEN t - lt END AS lag_residual FROM v LEFT JOIN m USING (id)""")
def spatial_lag_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances against the median of their 25 nearest that count."""
    k, value = F.col("c_custkey"), F.floor(F.col("c_acctbal") + 1000).cast("double")
    rows = table(spark, sf_dir, "customer").select(k.alias("parcel_id"), value.alias("taxable"), value.alias("taxable_per_acre"), (k % 11 == 0).alias("unjoined"), F.when(k % 7 == 0, "copied_full_assessment").otherwise("single_lot").alias("allocation"))
    return spatial.lags(rows, spatial.nearest(points(spark, sf_dir))).select("parcel_id", "lag_taxable", "lag_n", "lag_residual")
