"""Map flags, warnings, search and lookup."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions.lots import normalize_place, squeeze_code
from terrier.functions.values import IMPROVED, NO_COHORT, confidence_level

#: The codes of warnings in order, with their severity, and the score of each way to match.
WARNINGS = (("owner_property_card", "warn"), ("parent_join", "warn"), ("low_confidence", "warn"), ("owner_without_assessment", "info"), ("acreage_discrepancy", "info"), ("missing_owner", "info"), ("likely_public_owner", "info"))
SHORTEST_QUERY, LONGEST_QUERY, PER_TYPE, RESULTS = 2, 80, 5, 10
#: Stops of the colour ramp in percent, with red, green and blue.
#: Fill and line of a ramp over percentiles, and of parcels outside it.
EXEMPT_COLOURS, NO_COLOURS = ((107, 76, 154), (61, 42, 92)), ((138, 164, 176), (74, 106, 114))
LINE_RAMP = ((0, (2, 26, 51)), (25, (5, 48, 97)), (50, (214, 96, 77)), (75, (178, 24, 43)), (100, (59, 0, 18)))
RAMP = ((0, (5, 48, 97)), (25, (33, 102, 172)), (50, (244, 165, 130)), (75, (214, 96, 77)), (100, (103, 0, 31)))


def warnings() -> Column:
    """An array of structs (code, severity) from join_method, join_confidence, owner_name, total, acres_disagree, public and exempt."""
    owner, total = F.coalesce(F.col("owner_name"), F.lit("")) != "", F.coalesce(F.col("total"), F.lit("")) != ""
    tests = (
        F.col("join_method") == "property_card",
        F.col("join_method") == "map_lot_parent",
        confidence_level(F.col("join_confidence")) == "low",
        owner & ~total,
        F.col("acres_disagree"),
        ~owner,
        F.col("public") & ~F.col("exempt"),
    )
    each = [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for t, (code, severity) in zip(tests, WARNINGS, strict=True)]
    return F.filter(F.array(*each), lambda w: w.isNotNull())


def visible(mode: int | None, exempt: Column, cohort: Column) -> Column:
    """Whether a parcel shows in a cohort view; mode None shows all."""
    return F.lit(True) if mode is None else exempt | (cohort == NO_COHORT) | (cohort == mode)


def homestead_visible(mode: int | None, is_homestead: Column, cohort: Column) -> Column:
    return is_homestead if mode is None else is_homestead & (cohort == mode)


def valuation_colours(percent: Column, exempt: Column) -> Column:
    """struct(fill, line) of structs r, g, b: those of exempt parcels, of parcels without a rank, or on the ramp."""

    def colour(i: int, stops: tuple) -> Column:
        fixed = lambda c: F.struct(*[F.lit(x).cast("int").alias(n) for n, x in zip("rgb", c[i], strict=True)])
        return F.when(F.coalesce(exempt, F.lit(False)), fixed(EXEMPT_COLOURS)).when(percent.isNull() | (percent < 0), fixed(NO_COLOURS)).otherwise(ramp(percent, stops))

    return F.struct(colour(0, RAMP).alias("fill"), colour(1, LINE_RAMP).alias("line"))


def representatives(rows: DataFrame, tests: dict[str, Column], ordinal: str, key: str, size: int) -> DataFrame:
    """(label, key): the first row by ordinal that each test holds for, and then, labelled by their keys, the first rows that aren't picked, until there are `size`. Tests are worked out in one pass; no more than size and the number of tests are ever sorted out."""
    firsts = rows.agg(*[F.min_by(key, F.when(F.coalesce(t, F.lit(False)), F.col(ordinal))).alias(name) for name, t in tests.items()])
    picked = firsts.unpivot([], list(tests), "label", key).where(F.col(key).isNotNull())
    more = rows.select(key, ordinal).orderBy(ordinal).limit(size + len(tests))
    left = more.join(picked.select(key).distinct(), key, "left_anti").withColumn("turn", F.row_number().over(Window.orderBy(ordinal)))
    # One row with the number of labels, beside at most size + len(tests) rows.
    filled = left.crossJoin(F.broadcast(picked.agg(F.count("*").alias("labels")))).where(F.col("turn") + F.col("labels") <= size)
    return picked.unionByName(filled.select(F.col(key).alias("label"), key))


def ramp(percent: Column, stops: tuple = RAMP) -> Column:
    """struct(r, g, b) on the piecewise-linear ramp; null below 0."""

    def channel(i: int) -> Column:
        out = F.when(percent < 0, None)
        for (low, a), (high, b) in zip(stops, stops[1:], strict=False):
            out = out.when(percent <= high, a[i] + (b[i] - a[i]) * (percent - low) / float(high - low))
        return F.floor(out + 0.5).cast("int")

    return F.struct(*[channel(i).alias(c) for i, c in enumerate("rgb")])


def _all_tokens(text: Column, query: str) -> Column:
    tokens = query.split()
    return reduce(and_, [F.contains(text, F.lit(t)) for t in tokens]) if len(tokens) > 1 else F.lit(False)


def _plain(query: str) -> str:
    import re
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", bare).split())


def index_parcels(parcels: DataFrame) -> DataFrame:
    """id, label and search fields of parcels (id, owner_name, situs, lot, account); rows without any field are left out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = parcels.select("id", F.coalesce(text("situs"), text("owner_name"), text("lot"), "id").alias("label"), F.nullif(normalize_place(F.col("owner_name")), F.lit("")).alias("owner_key"), F.nullif(normalize_place(F.col("situs")), F.lit("")).alias("situs_key"), squeeze_code(F.col("lot")).alias("lot_key"), squeeze_code(F.col("account")).alias("account_key"))
    return out.where("coalesce(owner_key, situs_key, lot_key, account_key) is not null")


def search_parcels(index: DataFrame, query: str, limit: int = RESULTS) -> DataFrame:
    """The best matches: id, label, score; of equal scores the label's order in Unicode collation, then the id."""
    q, code = _plain(query), "".join(query.split()).upper()
    o, s, lot = F.col("owner_key"), F.col("situs_key"), F.col("lot_key")
    score = (
        F.when(F.lit(len(q) < SHORTEST_QUERY), 0)
        .when(F.col("account_key") == code, 100)
        .when(lot == code, 95)
        .when(lot.startswith(code), 85)
        .when(s == q, 75)
        .when(o == q, 80)
        .when(F.contains(s, F.lit(q)), 55)
        .when(F.contains(o, F.lit(q)), 60)
        .when(F.contains(lot, F.lit(code)), 50)
        .when(_all_tokens(o, q) | _all_tokens(s, q), 40)
        .otherwise(0)
    )
    return index.select("id", "label", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), F.expr("label collate UNICODE"), "id").limit(limit)


def search_places(places: DataFrame, query: str, limit: int = RESULTS, municipality: str | None = None) -> DataFrame:
    """places (id, name, name_key, municipality_id, rank): the best matches, id, name, score."""
    q, name = _plain(query), F.col("name_key")
    score = F.when(F.lit(len(q) < SHORTEST_QUERY), 0).when(name == q, 100).when(name.startswith(q), 80).when(F.contains(name, F.lit(q)), 50).when(_all_tokens(name, q), 40).otherwise(0)
    rows = places if municipality is None else places.where(F.col("municipality_id") == municipality)
    found = rows.withColumn("score", score).where("score > 0").select("id", "name", (F.col("score") + F.col("rank")).alias("score"))
    return found.orderBy(F.col("score").desc(), F.expr("name collate UNICODE"), "id").limit(limit)


def search_all(index: DataFrame, places: DataFrame, query: str, per_type: int = PER_TYPE) -> DataFrame:
    """The best of both, tagged by type."""
    if not SHORTEST_QUERY <= len(query) <= LONGEST_QUERY:
        raise ValueError(f"a query has {SHORTEST_QUERY} to {LONGEST_QUERY} characters")
    a = search_parcels(index, query, per_type).select(F.lit("parcel").alias("type"), "id", F.col("label").alias("name"), "score")
    return a.unionByName(search_places(places, query, per_type).select(F.lit("place").alias("type"), "id", "name", "score"))


def improved_only(cohort: Column) -> Column:
    return cohort == IMPROVED
