"""Rules that note what stands out. Nothing here is a finding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions.owners import is_institution
from terrier.operators.components import connected_components
from terrier.operators.peers import MIN_PEERS, preferred
from terrier.operators.ranks import keyed
from terrier.sources.scratch import written

#: The rules' thresholds.
MIN_SHARE, MAX_PERCENTILE = 0.2, 0.1
HOLE_TOUCHES, HOLE_SHARE = 3, 0.75
GAP_RATE, GAP_NEIGHBOUR_RATE = 0.05, 0.9
SPREAD_LOTS, SPREAD_RATIO, SPREAD_RANGE = 2, 3, 10
DEVIANT_LOW, DEVIANT_HIGH = 0.05, 0.95
PARTS_RATIO, PARTS_GAP = 1.25, 1000
TRACT_ACRES, TRACT_TOUCHES, TRACT_SHARE = 100, 3, 0.75
PACKET_PARCELS = 25
#: What the rules on touching parcels ask of either end.
KNOWN = ("unjoined", "family", "vacant", "acres", "township", "owner")
RELATION = "struct<type: string, source: string, target: string, score: double>"


def _named(rule: str, key: Column, rows: DataFrame, *columns) -> DataFrame:
    """Observations: id, type, scope, observed, expected, percentile, priority, confidence, flags, owners, parcels (the first PACKET_PARCELS by id) and how many there are, relations (as many) and how many, and their highest score; `columns` give those that differ from the defaults."""
    given = {c._jc.toString().rpartition(" AS ")[2].strip("`"): c for c in columns}
    number, none = F.lit(None).cast("double"), F.array().cast("array<string>")
    defaults = {
        "observed": number, "expected": number, "percentile": number, "priority": F.lit("low"), "confidence": F.lit(0.5), "flags": none, "owners": none, "parcels": none, "parcel_count": F.lit(0).cast("long"),
        "relations": F.array().cast(f"array<{RELATION}>"), "relation_count": F.lit(0).cast("long"), "top_score": number,
    }
    rest = [c for n, c in given.items() if n not in defaults]
    return rows.select(F.concat(F.lit(f"obs:{rule}:"), key).alias("id"), F.lit(rule).alias("type"), key.alias("scope"), *[given.get(n, d).alias(n) for n, d in defaults.items()], *rest)


def _members(hits: DataFrame, keys: list[str], *found, column: str = "parcel_id") -> DataFrame:
    """A row for each group of hits (keys and `column`): how many as parcel_count, the first PACKET_PARCELS of `column` as members, and `found`. The first are picked before they meet, so a group may have any size."""
    held = written(hits, "hits")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    first = held.withColumn("turn", turn).where(F.col("turn") <= PACKET_PARCELS).groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias("members"))
    return keyed(held.groupBy(*keys).agg(F.count("*").alias("parcel_count"), *found), first, keys)


def _around(touches: DataFrame, asks: Callable[[Column], Column], counts: Callable[[Column], Column], *kept: str) -> DataFrame:
    """For parcels of which `asks` holds: parcel_id, its fields `kept`, n (all touches) and share of those of which `counts` holds. Both ends of a touch come with it, so no parcel has to be looked up, and only what asks is counted. Either end is read on its own: that takes fewer fields than turning each row."""
    side = lambda id_, own, other: touches.where(asks(F.col(own))).select(F.col(id_).alias("parcel_id"), *[F.col(own)[c].alias(c) for c in kept], F.coalesce(counts(F.col(other)), F.lit(False)).alias("hit"))
    each = side("id", "own", "other").unionByName(side("neighbour_id", "other", "own")).groupBy("parcel_id", *kept).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return each.withColumn("share", F.col("hits") / F.col("n"))


def _flags(*names: str) -> Column:
    return F.array(*map(F.lit, names)).alias("flags")


def _how_many() -> tuple[Column, ...]:
    """What an observation on a number of parcels says of them."""
    return F.col("parcel_count").cast("double").alias("observed"), F.col("parcel_count").alias("parcel_count"), F.col("members").alias("parcels")


def copied_acre_spread(rows: DataFrame) -> DataFrame:
    """Groups of lots with a copied value whose acres differ widely; the first lot is related to each other one."""
    positive = F.when(F.col("acres") > 0, F.col("acres"))
    groups = rows.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("allocation") == "copied_full_assessment", F.lit(False))).alias("copied"), F.min(positive).alias("low"), F.max(positive).alias("high"), F.count(positive).alias("known"))
    hits = groups.where((F.col("n") >= SPREAD_LOTS) & F.col("copied") & (F.col("known") >= 2) & (F.col("high") / F.col("low") >= SPREAD_RATIO) & (F.col("high") - F.col("low") >= SPREAD_RANGE))
    lots = _members(rows.select("group_id", "parcel_id").join(hits.select("group_id", "low", "high"), "group_id"), ["group_id"], F.first("low").alias("low"), F.first("high").alias("high"))
    related = F.transform(F.slice("members", 2, PACKET_PARCELS), lambda p: F.struct(F.lit("copied_assessment").alias("type"), F.col("members")[0].alias("source"), p.alias("target"), F.lit(None).cast("double").alias("score")))
    _, *named = _how_many()
    return _named("copied_multilot_acre_spread", F.col("group_id"), lots, (F.col("high") / F.col("low")).alias("observed"), F.lit(1.0).alias("expected"), F.lit(0.8).alias("confidence"), *named, related.alias("relations"), (F.col("parcel_count") - 1).alias("relation_count"), _flags("copied_full_assessment"))


def parts_above_taxable(rows: DataFrame) -> DataFrame:
    """Land and building far above the taxable value although no exemption is known, by township. A taxable value of 0 or less passes any ratio."""
    gap, ratio = F.col("land_building") - F.col("taxable"), F.when(F.col("taxable") > 0, F.col("land_building") / F.col("taxable"))
    hits = rows.where(F.col("exemption").isNull() & (gap >= PARTS_GAP) & ((F.col("taxable") <= 0) | (ratio >= PARTS_RATIO)))
    towns = _members(hits.select(F.coalesce("township", F.lit("_none")).alias("town"), "parcel_id"), ["town"])
    return _named("land_building_vs_taxable_exemption_null", F.col("town"), towns, *_how_many(), F.lit(0.6).alias("confidence"), _flags("exemption_null"))


def plat_holes(touches: DataFrame) -> DataFrame:
    """Parcels without a tax record most of whose neighbours on the book's maps have one, by township. touches: each once, with KNOWN of either end as own and other (spatial.touching_once)."""
    around = _around(touches, lambda p: p["unjoined"], lambda p: ~p["unjoined"] & (p["family"] == "wa_map"), "township")
    hits = around.where((F.col("n") >= HOLE_TOUCHES) & (F.col("share") >= HOLE_SHARE))
    towns = _members(hits.select(F.coalesce("township", F.lit("_none")).alias("town"), "parcel_id"), ["town"])
    return _named("unjoined_plat_hole", F.col("town"), towns, *_how_many(), F.lit(0.85).alias("confidence"), _flags("unjoined", "plat_join_gap"))


def vacant_among_improved(touches: DataFrame) -> DataFrame:
    """Large vacant tracts most of whose neighbours are improved, by owner; touches as in plat_holes()."""
    around = _around(touches, lambda p: p["vacant"] & (p["acres"] >= TRACT_ACRES), lambda p: ~p["vacant"] & ~p["unjoined"], "owner")
    hits = around.where((F.col("n") >= TRACT_TOUCHES) & (F.col("share") >= TRACT_SHARE))
    each = _members(hits.select("owner", "parcel_id"), ["owner"])
    institution = is_institution(F.col("owner"))
    flags = F.when(institution, F.array(F.lit("vacant"), F.lit("institutional_baseline"))).otherwise(F.array(F.lit("vacant")))
    return _named("vacant_tract_among_improved", F.coalesce("owner", F.lit("_unknown")), each, *_how_many(), F.when(institution, "suppressed").otherwise("low").alias("priority"), F.array_compact(F.array("owner")).alias("owners"), flags.alias("flags"))


def join_gaps(rows: DataFrame, touches: DataFrame) -> DataFrame:
    """Townships with next to no tax records beside ones with nearly all; touches as in plat_holes(), with the township of either end."""
    rates = rows.where("township is not null").groupBy("township").agg(F.count("*").alias("n"), F.avg(F.when(~F.col("unjoined"), 1.0).otherwise(0.0)).alias("rate"))
    town = rows.select("parcel_id", "township")
    met = touches.select(F.col("own.township").alias("township"), F.col("other.township").alias("beside")).where("township != beside").distinct()
    pairs = met.unionByName(met.select(F.col("beside").alias("township"), F.col("township").alias("beside")))
    full = rates.where(F.col("rate") >= GAP_NEIGHBOUR_RATE).select(F.col("township").alias("beside"))
    hits = rates.where(F.col("rate") <= GAP_RATE).join(pairs.join(full, "beside", "left_semi").select("township").distinct(), "township", "left_semi")
    gaps = _members(town.join(hits.select("township", "rate"), "township"), ["township"], F.first("rate").alias("rate"))
    _, *named = _how_many()
    return _named("township_join_gap", F.col("township"), gaps, F.col("rate").alias("observed"), *named, F.lit(0.9).alias("confidence"), _flags("unjoined", "township_join_gap"))


def unjoined_records(rows: DataFrame, year: int) -> DataFrame:
    """One observation on how many records have no land, if there are any. It names none."""
    count = rows.where("unjoined").agg(F.count("*").alias("n")).where("n > 0")
    return _named("unjoined_tax_records", F.lit(str(year)), count, F.col("n").cast("double").alias("observed"), F.lit(0.0).alias("expected"), F.lit(0.95).alias("confidence"), _flags("unjoined_tax", "records_without_land"))


def mail_elsewhere(scores: DataFrame, organized: DataFrame) -> DataFrame:
    """One observation on parcels outside organized townships whose mail goes to one and whose value stands out. organized (township)."""
    percentile = preferred("band", "town", field="percentile")
    away = scores.join(organized.select(F.col("township").alias("mail_town")), "mail_town", "left_semi").join(organized, "township", "left_anti")
    hits = away.where((percentile <= DEVIANT_LOW) | (percentile >= DEVIANT_HIGH))
    count = _members(hits.select(F.lit("all").alias("scope"), "parcel_id"), ["scope"])
    return _named("mail_organized_peer_deviant", F.col("scope"), count, *_how_many(), F.lit(0.45).alias("confidence"), _flags("mail_city_ne_gis_town"))


def high_share_low_value(rows: DataFrame, shares: DataFrame, scores: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Owners of a large share of a township's acres whose vacant land there is worth little an acre. What it says of the metric is that of the first such parcel."""
    low = rows.where("vacant and owner is not null").select("owner", "township", "parcel_id", "ordinal").join(scores.where((F.col("town_vpa_n") >= MIN_PEERS) & (F.col("town_vpa_percentile") <= MAX_PERCENTILE)).select("parcel_id", "town_vpa_percentile"), "parcel_id")
    large = low.join(shares.where(F.col("acre_share") >= min_share).select("owner", "township", "acre_share"), ["owner", "township"])
    hits = _members(large, ["owner", "township"], F.first("acre_share").alias("acre_share"), F.min_by("town_vpa_percentile", "ordinal").alias("first_percentile"))
    institution = is_institution(F.col("owner"))
    _, *named = _how_many()
    return _named(
        "high_local_share_low_vpa", F.concat_ws("~", "owner", "township"), hits, F.when(institution, "suppressed").otherwise("medium").alias("priority"), F.when(institution, 0.7).otherwise(0.5).alias("confidence"), F.array("owner").alias("owners"), *named,
        F.when(institution, F.array(F.lit("institutional_baseline"), F.lit("vacant"))).otherwise(F.array(F.lit("vacant"))).alias("flags"), F.col("acre_share").alias("share"), F.col("first_percentile").alias("percentile"),
    )


def similar_neighbours(edges: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Groups of owners whose names are similar and whose land touches, from edges (a, b, score), with the edges as relations and, from rows (parcel_id, owner), the owners' parcels."""
    held = written(edges.select("a", "b", "score"), "similar")
    nodes = written(connected_components(held, "a", "b"), "groups")
    groups = nodes.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("names"))
    inside = held.join(nodes.select(F.col("node").alias("a"), "component"), "a")
    turn = F.row_number().over(Window.partitionBy("component").orderBy("a", "b"))
    first = inside.withColumn("turn", turn).where(F.col("turn") <= PACKET_PARCELS).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "score"))), lambda e: F.struct(F.lit("similar_name").alias("type"), e["a"].alias("source"), e["b"].alias("target"), e["score"].alias("score"))).alias("edges"))
    out = groups.join(inside.groupBy("component").agg(F.count("*").alias("edge_count"), F.max("score").alias("top")), "component").join(first, "component")
    named = [F.col("edges").alias("relations"), F.col("edge_count").alias("relation_count"), F.col("top").alias("top_score")]
    if rows is not None:
        owned = _members(rows.select("parcel_id", F.col("owner").alias("node")).join(nodes, "node").select("component", "parcel_id"), ["component"])
        out = out.join(owned, "component", "left")
        named += [F.coalesce("parcel_count", F.lit(0)).cast("long").alias("parcel_count"), F.coalesce("members", F.array().cast("array<string>")).alias("parcels")]
    return _named("similar_name_adjacent", F.array_join("names", "~"), out, F.lit("medium").alias("priority"), F.lit(0.55).alias("confidence"), F.col("names").alias("owners"), *named, _flags("similar_name_not_same_entity"))


def newest(rows: DataFrame, key: str, date: str, ordinal: str) -> DataFrame:
    """The latest row of each key; of equal dates the first."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), ordinal)
    return rows.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")
