"""Packets of the evidence behind observations, what is said of them, and checks that this says no more than they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.values import let
from terrier.operators.observations import PACKET_PARCELS

#: Flags that mark an artifact of the data; the score from which similar names are ordinary; words that accuse; what counts as a number; tokens that are too long to be checked.
ARTIFACTS = ("plat_join_gap", "township_join_gap", "copied_full_assessment", "unjoined_tax", "records_without_land")
INSTITUTIONAL, EXTREME, LONGEST_NUMBER = "institutional_baseline", 0.999, 12
FORBIDDEN = r"(?i)\b(fraud|evasion|illegal|crime|criminal|steal|stolen|launder|tax.?cheat)\b"
_NUMBER = r"-?\d+(?:\.\d+(?:[eE][+-]?\d+)?)?"
_PARCEL = ("parcel_id", "township", "owner_raw", "acres", "taxable", "land", "building", "exemption", "taxable_per_acre", "vacant", "unjoined", "allocation", "family")


def _in_order(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    """The rows of each id (`at` is their order) as one array of structs."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("row")))), lambda x: x["row"])
    return rows.groupBy("id").agg(listed.alias(column))


def build_packets(observations: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """observations with what is known of what they name: `parcels` and `owners` as structs, as many as PACKET_PARCELS of each, beside how many there are in all. rows: parcels with _PARCEL, null where a parcel is unknown; entities: owners (owner, institution, parcels, acres, max_town_share), of which an unknown one has none."""
    named = observations.select("id", F.posexplode("parcels").alias("at", "parcel_id")).join(rows.select(*_PARCEL), "parcel_id", "left")
    known = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("vacant", "unjoined")})
    of = entities.select(F.col("owner").alias("name"), "institution", F.col("parcels").alias("parcel_count"), "acres", "max_town_share")
    owners = observations.select("id", F.posexplode(F.slice("owners", 1, PACKET_PARCELS)).alias("at", "name")).join(of, "name", "left")
    owners = owners.withColumns({"institution": F.coalesce("institution", F.lit(False)), "parcel_count": F.coalesce("parcel_count", F.lit(0)).cast("long"), "acres": F.coalesce("acres", F.lit(0.0))})
    held, held_by = _in_order(known, "held", *_PARCEL), _in_order(owners, "held_by", "name", "institution", "parcel_count", "acres", "max_town_share")
    out = observations.withColumn("owner_count", F.size("owners").cast("long")).drop("parcels", "owners").join(held, "id", "left").join(held_by, "id", "left")
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return out.withColumns({"parcels": empty("held", held), "owners": empty("held_by", held_by)}).drop("held", "held_by")


def classify() -> Column:
    """Of an observation, the first that fits: an institution's baseline, an artifact of the data, ordinary for names that are alike but for the order of their words, or unexplained."""
    artifact = F.arrays_overlap("flags", F.array(*map(F.lit, ARTIFACTS)))
    ordinary = (F.col("type") == "similar_name_adjacent") & F.coalesce(F.col("top_score") >= EXTREME, F.lit(False))
    return F.when(F.array_contains("flags", INSTITUTIONAL), INSTITUTIONAL).when(artifact, "artifact").when(ordinary, "ordinary").otherwise("unexplained")


def packet_json(packets: DataFrame) -> DataFrame:
    """(id, json): each packet in full, as it would be handed on."""
    return packets.select("id", F.to_json(F.struct("*")).alias("json"))


def numbers(text: Column) -> Column:
    """The numbers that a text shows, as they stand."""
    return F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))


def allowed_numbers(json: Column) -> Column:
    """What a text on a packet may show, as an array of doubles: each number in it, and that rounded (halves up)."""
    found = F.filter(F.transform(F.array_distinct(numbers(json)), lambda t: t.try_cast("double")), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x, F.floor(x + 0.5).cast("double")))))


def missing(packets: DataFrame) -> Column:
    """Names of what the packet lacks."""
    lacks = lambda c: F.exists("parcels", lambda p: p[c].isNull())
    return F.array_compact(F.array(*[F.when(lacks(c), F.lit(c)) for c in ("acres", "taxable_per_acre")], *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("observed", "expected")]))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def hypotheses(packets: DataFrame) -> DataFrame:
    """(id, about, class, text, cited, missing): a text that cites only what is in the packet, the values that it cites, and what is missing."""
    lack = missing(packets)
    note = F.when(F.size(lack) > 0, F.concat(F.lit(" Not in this packet: "), F.array_join(lack, ", "), F.lit("."))).otherwise("")
    residual = (F.col("observed") - F.col("expected")).cast("string")
    unusual = (
        F.when(F.col("observed").isNotNull() & F.col("expected").isNotNull(), F.concat(F.lit("Packet observed="), _shown("observed"), F.lit(" expected="), _shown("expected"), F.lit(".")))
        .when(F.col("observed").isNotNull(), F.concat(F.lit("Packet observed="), _shown("observed"), F.lit(".")))
        .otherwise("No observed value is in this packet.")
    )
    scope = F.concat(F.lit(" Scope "), F.col("scope"), F.lit("; parcels named="), F.col("parcel_count").cast("string"), F.lit(" shown="), F.size("parcels").cast("string"), F.lit("; relations="), F.col("relation_count").cast("string"), F.lit("."))
    cited = F.map_filter(F.create_map(*[x for c in ("observed", "expected", "percentile") for x in (F.lit(c), F.col(c).cast("string"))], F.lit("residual"), residual, F.lit("parcel_count"), F.col("parcel_count").cast("string"), F.lit("shown"), F.size("parcels").cast("string")), lambda k, v: v.isNotNull())
    return packets.select("id", F.col("id").alias("about"), classify().alias("class"), F.concat(F.translate("type", "_", " "), F.lit(": "), unusual, scope, note, F.lit(" Warrants review.")).alias("text"), cited.alias("cited"), lack.alias("missing"))


def validate(packets: DataFrame, said: DataFrame) -> DataFrame:
    """said (id of a packet, about, text, and what else it has) with `errors`: words that accuse, numbers that aren't in the packet, and an observation that isn't its. Every packet is serialised once; what is said of a packet that isn't there is left out."""
    held = packet_json(packets.withColumn("shown", F.size("parcels"))).select("id", allowed_numbers(F.col("json")).alias("allowed"))
    checked = F.filter(numbers(F.col("text")), lambda t: F.length(t) <= LONGEST_NUMBER)
    strange = F.filter(checked, lambda t: ~F.array_contains("allowed", t.cast("double")))
    error = lambda wrong, what: F.when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(error(F.col("text").rlike(FORBIDDEN), "forbidden vocabulary"), F.transform(strange, lambda t: F.concat(F.lit("uncited number "), t)), error(F.col("about") != F.col("id"), "observation id mismatch"))
    return said.join(held, "id").withColumn("errors", let(errors, lambda e: F.coalesce(e, F.array(F.lit("no text"))))).drop("allowed")
