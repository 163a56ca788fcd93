"""Packets: what they hold, how they are classed, and what may be said of them."""

import json

from pyspark.sql import functions as F

from terrier.operators import observations, packets

ROW = "parcel_id string, township string, owner string, owner_raw string, acres double, taxable double, land double, building double, exemption double, taxable_per_acre double, vacant boolean, unjoined boolean, allocation string, family string, group_id string"


def _rows(spark):
    rows = [(f"P{i:03}", "T", "DOE JOHN" if i % 2 else "JOHN DOE", "Doe, John", float(1 + i * 20), 100.5 + i, 50.0, 50.0, None, None, False, False, "copied_full_assessment", "wa_map", "G1") for i in range(40)]
    return spark.createDataFrame([*rows, ("Q1", None, None, None, None, None, None, None, None, None, None, None, None, None, None)], ROW)


def _entities(spark):
    return spark.createDataFrame([("DOE JOHN", False, 20, 7.25, 0.5)], "owner string, institution boolean, parcels long, acres double, max_town_share double")


def _found(spark):
    rows = _rows(spark)
    edges = spark.createDataFrame([("DOE JOHN", "JOHN DOE", 1.0), ("ANN ROE", "ANNA ROE", 0.95)], "a string, b string, score double")
    every = observations.copied_acre_spread(rows).unionByName(observations.similar_neighbours(edges, rows))
    return packets.build_packets(every, rows, _entities(spark))


def test_packets_show_the_first_and_count_all(spark):
    got = {r.scope: r for r in _found(spark).withColumn("class", packets.classify()).collect()}
    copied, alike, other = got["G1"], got["DOE JOHN~JOHN DOE"], got["ANN ROE~ANNA ROE"]
    assert copied.parcel_count == 40 and [p.parcel_id for p in copied.parcels] == [f"P{i:03}" for i in range(25)] and copied.observed == 781.0
    assert copied.relation_count == 39 and all(r.source == "P000" and r.type == "copied_assessment" for r in copied.relations)
    assert [(o.name, o.parcel_count, o.acres, o.max_town_share) for o in alike.owners] == [("DOE JOHN", 20, 7.25, 0.5), ("JOHN DOE", 0, 0.0, None)]
    assert alike.parcel_count == 40 and alike.relation_count == 1 and alike.relations[0].score == 1.0
    assert other.parcels == [] and other.parcel_count == 0 and other.owner_count == 2
    assert (copied["class"], alike["class"], other["class"]) == ("artifact", "ordinary", "unexplained")


def test_what_is_said_of_a_packet(spark):
    held = _found(spark)
    told = packets.hypotheses(held)
    assert {tuple(r.errors) for r in packets.validate(held, told).collect()} == {()}
    one = told.where("about like '%G1'")
    text = one.first().text
    assert "observed=781.0" in text and "named=40 shown=25" in text and "taxable_per_acre" in text
    cases = {" 100.5 and 101 and 39": [], " 101.4": ["uncited number 101.4"], " -39": ["uncited number -39"], " He stole it, a tax cheat": ["forbidden vocabulary"], " 1234567890123": [], " criminality": []}
    said = one.select("id", "about", F.explode(F.array(*map(F.lit, cases))).alias("more")).withColumn("text", F.col("more"))
    assert {r.more: r.errors for r in packets.validate(held, said).collect()} == cases
    foreign = said.limit(1).withColumn("about", F.lit("obs:x")).withColumn("text", F.lit("fraud 77777"))
    assert packets.validate(held, foreign).first().errors == ["forbidden vocabulary", "uncited number 77777", "observation id mismatch"]
    assert packets.validate(held, foreign.withColumn("id", F.lit("obs:x"))).count() == 0


def test_packets_are_serialised_in_full(spark):
    whole = {json.loads(r.json)["scope"]: json.loads(r.json) for r in packets.packet_json(_found(spark)).collect()}
    assert len(whole["G1"]["parcels"]) == 25 and whole["G1"]["parcels"][0]["allocation"] == "copied_full_assessment" and whole["DOE JOHN~JOHN DOE"]["relations"][0]["target"] == "JOHN DOE"


def test_observations_read_line_items_once(spark, monkeypatch):
    """Touches and scores are made of the parcels as written; each used to sum all line items again."""
    from terrier.plans import owners as plans
    from terrier.plans import views

    read, table = [], views.table
    monkeypatch.setattr(views, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    every, _ = plans._observations(spark, "/root/testdata/sf0.001")
    assert every.where("type is null").count() == 0 and read.count("lineitem") == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_on_touches_join_no_parcels(spark, monkeypatch):
    """What is asked of either end goes along with a touch; tables of touches were joined six times before."""
    known = "struct<unjoined: boolean, family: string, vacant: boolean, acres: double, township: string, owner: string>"
    hole, full, tract = (True, "plat", False, None, "T", "A"), (False, "wa_map", False, 1.0, "U", "B"), (False, "wa_map", True, 100.0, "T", None)
    touches = spark.createDataFrame([("a", "b", hole, full), ("a", "c", hole, full), ("b", "t", full, tract), ("c", "t", full, tract), ("a", "t", hole, tract), ("d", "t", full, tract), ("e", "t", full, tract)], f"id string, neighbour_id string, own {known}, other {known}")
    plans, written = [], observations.written
    monkeypatch.setattr(observations, "written", lambda df, name: plans.append(_plan(df)) or written(df, name))
    holes = [tuple(r) for r in observations.plat_holes(touches).select("scope", "observed", "parcels").collect()]
    tracts = [tuple(r) for r in observations.vacant_among_improved(touches).select("scope", "observed", "parcels").collect()]
    assert holes == [("T", 1.0, ["a"])] and tracts == [("_unknown", 1.0, ["t"])]
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_names_are_compared_once_a_pair_of_owners(spark):
    """A filter on a pair's names used to be pushed down below the sums, to every touch."""
    from terrier.operators import ownership

    none = spark.createDataFrame([], "owner string, township string, mail string")
    edges = ownership.similar_edges(ownership.candidate_pairs(none, spark.createDataFrame([("ANN ROE", "ANNA ROE")] * 9, "a string, b string")))
    assert [(r.a, r.b, r.type) for r in edges.collect()] == [("ANN ROE", "ANNA ROE", "similar_name")]
    assert "Aggregate" not in _plan(edges)
