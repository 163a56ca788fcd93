"""Plans that the driver must hold stay small."""

from terrier.operators import components


def test_a_round_of_components_reads_its_links_four_times_at_most(spark):
    """Each reading is a copy of the plan in the driver's memory; the two stars once made sixteen."""
    links = spark.createDataFrame([(2, 1), (3, 2), (7, 5)], "node long, other long")
    got = components._round(links)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
    assert {tuple(r) for r in got.collect()} == {(2, 1), (3, 1), (7, 5)}


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (200, 202), (300, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}
