"""Money, acres, exemptions and flags: columns that keep missing values missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges and thresholds.
MONEY_LOW, MONEY_HIGH = 100, 50_000_000
HOMESTEAD_AMOUNTS = (25_000, 31_000)
ACRE_GAP, ACRE_GAP_SHARE = 0.5, 0.1
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.85, 0.6
BAND_EDGES = ((2, "lt2"), (10, "2to10"), (40, "10to40"), (200, "40to200"))
LAST_BAND = "ge200"
BAND_LABELS = {"lt2": "<2 ac", "2to10": "2–10 ac", "10to40": "10–40 ac", "40to200": "40–200 ac", "ge200": "≥200 ac"}
MILL_RATE, MILL_TOLERANCE = 0.0145, 1.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def worked_out(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row, however often and by whatever filter they are read afterwards: a plain select is copied into each reader."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def bare(text: Column) -> Column:
    """Without commas and outer blanks."""
    return F.trim(F.replace(text, F.lit(","), F.lit("")))


def number(text: Column) -> Column:
    """A number from source text: null for null, empty or unreadable text. Blank text that isn't empty reads as 0."""
    plain = bare(text)
    readable = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(text == "", None).when(plain == "", 0.0).when(readable, plain.try_cast("double"))


def amount(text: Column) -> Column:
    """A non-negative amount: digits with at most one point, commas aside."""
    return F.when(bare(text).rlike(r"^\d+(\.\d+)?$"), bare(text).try_cast("double"))


def acres(text: Column) -> Column:
    """A positive acreage."""
    return let(number(text), lambda x: F.when(x > 0, x))


def is_money(text: Column) -> Column:
    """Whole amounts in the plausible range. False for null."""
    return F.coalesce(bare(text).rlike(r"^\d+$") & bare(text).try_cast("double").between(MONEY_LOW, MONEY_HIGH), F.lit(False))


def exemption(text: Column) -> Column:
    """The cleaned text of a positive exemption."""
    return F.when(number(text) > 0, bare(text))


def per_acre(value: Column, acreage: Column) -> Column:
    return F.when(acreage > 0, value / acreage)


def acreage_band(acreage: Column) -> Column:
    out = F.when(acreage < 0, None)
    for edge, name in BAND_EDGES:
        out = out.when(acreage < edge, name)
    return out.when(acreage >= BAND_EDGES[-1][0], LAST_BAND)


def band_label(band: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BAND_LABELS.items() for x in pair])[band]


def acres_disagree(gis: Column, tax: Column) -> Column:
    """Whether two acreages differ by more than half an acre or a tenth; false if either is missing."""
    return F.coalesce(F.abs(gis - tax) > F.greatest(F.lit(ACRE_GAP), F.abs(tax) * ACRE_GAP_SHARE), F.lit(False))


def confidence_level(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= HIGH_CONFIDENCE, "high").when(score >= MEDIUM_CONFIDENCE, "medium").otherwise("low")


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def mill_check(assessed: Column, tax: Column, rate: float = MILL_RATE) -> Column:
    """struct(expected, ok): whether a tax is what the rate makes of the assessment, to within a unit."""
    expected = round_half_up(assessed * rate * 100) / 100
    return F.struct(expected.alias("expected"), (F.abs(expected - tax) <= MILL_TOLERANCE).alias("ok"))


def log1p_safe(x: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), x))


def merge_attributes(base: Column, over: Column) -> Column:
    """Two JSON objects as one, as JSON text with its keys in order: what `over` says counts, nested values as a whole, a null too. What is no object adds nothing."""
    entries = lambda text: F.coalesce(F.try_parse_json(text).try_cast("map<string, variant>"), F.expr("cast(map() as map<string, variant>)"))
    a, b = entries(base), entries(over)
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return let(F.struct(a.alias("a"), b.alias("b"), keys.alias("k")), lambda s: F.to_json(F.map_from_arrays(s["k"], F.transform(s["k"], lambda k: F.when(F.map_contains_key(s["b"], k), F.try_element_at(s["b"], k)).otherwise(F.try_element_at(s["a"], k))))))


# Exemption and cohort rules.

NO_COHORT, UNIMPROVED, IMPROVED, NO_PERCENT = -1, 0, 1, -1


def building_cohort(building: Column) -> Column:
    return let(amount(building), lambda b: F.when(b.isNull(), NO_COHORT).when(b == 0, UNIMPROVED).otherwise(IMPROVED))


def fully_exempt(exempt: Column, total: Column, land: Column, building: Column) -> Column:
    """An exemption as large as the total; where the total is missing, as large as land and building together."""
    e, t = amount(exempt), amount(total)
    sums = F.coalesce(amount(land), F.lit(0.0)) + F.coalesce(amount(building), F.lit(0.0))
    return F.coalesce((t > 0) & (e >= t), F.lit(False)) | F.coalesce(t.isNull() & (e > 0) & (sums > 0) & (e >= sums), F.lit(False))


def homestead(exempt: Column, label: Column) -> Column:
    return F.coalesce(label, F.lit(False)) | F.coalesce(amount(exempt).isin(*map(float, HOMESTEAD_AMOUNTS)), F.lit(False))


def value_per_acre(total: Column, acreage: Column) -> Column:
    return F.when(is_money(total), amount(total) / acres(acreage))


def clamp_percent(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x < 0), NO_PERCENT).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(x))))


def coverage_tier(has_owner: Column, total: Column) -> Column:
    return F.when(has_owner & is_money(total), 2).when(has_owner, 1).otherwise(0)


def program(tree_growth: Column, exempt: Column) -> Column:
    return F.when(tree_growth, 2).when(exempt, 1).otherwise(0)
