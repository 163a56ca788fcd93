"""Columns that a filter reads after them are worked out once a row."""

from pyspark.sql import functions as F

from terrier.functions.values import worked_out
from terrier.operators import features, spatial
from terrier.plans import places

SF = "/root/testdata/sf0.001"


def test_worked_out_is_not_copied_into_readers(spark):
    rows = worked_out(spark.range(3), F.concat(F.lit("only-here-"), F.col("id").cast("string")).alias("text"))
    plan = rows.where("text != 'x' and length(text) > 2").select("text", F.upper("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only-here-") == 1


def test_touches_are_measured_once(spark):
    """Each pair's distance was worked out for the filter, for the column, and again for the other way round."""
    plan = places.touches(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_nearest_makes_no_row_of_a_pair_in_its_first_round(spark, monkeypatch):
    """An even lattice is sure of its nearest at once, without the join that makes pairs."""
    monkeypatch.setattr(spatial, "_nearest_once", None)
    points = spark.range(2500).select("id", (F.col("id") % 50 + F.rand(1) / 9).alias("x"), (F.floor(F.col("id") / 50) + F.rand(2) / 9).alias("y")).cache()
    rows = {x.id: (x.x, x.y) for x in points.collect()}
    inside = points.withColumn("asks", F.col("x").between(10, 40) & F.col("y").between(10, 40))
    got = {}
    for x in spatial.nearest(inside, k=5, asks="asks").collect():
        got.setdefault(x.id, {})[x.rank] = x.neighbour_id
    assert len(got) > 800
    for i in list(got)[::50]:
        d = sorted(((rows[i][0] - a) ** 2 + (rows[i][1] - b) ** 2, j) for j, (a, b) in rows.items() if j != i)
        assert [got[i][r] for r in range(1, 6)] == [j for _, j in d[:5]]


def test_tiles_of_a_small_file_are_dealt_over_all_parts(spark):
    boxes = spark.range(20).coalesce(1).select("id", F.expr("named_struct('west', -67.6D, 'south', 45.0D, 'east', -67.4D, 'north', 45.2D)").alias("box"))
    assert features.tile_cover(boxes, range(8, 11), 16).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_names_of_owners_are_worked_out_once_an_owner(spark):
    """Below the join that gives each parcel its owner, and in one place only: an owner has ten parcels or more."""
    from terrier.plans import owners as plans

    plan = plans.rows(spark, "/root/testdata/sf0.001").where("owner is not null").select("owner", "parcel_id")._jdf.queryExecution().optimizedPlan().toString()
    name = [line for line in plan.splitlines() if "ET AL" in line]
    assert len(name) == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    parcels = next(line for line in plan.splitlines() if "Join" in line and "o_custkey" in line)
    assert depth(parcels) < depth(name[0])
