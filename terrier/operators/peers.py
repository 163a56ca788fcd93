"""Parcel features and scores against peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.values import acreage_band, band_label, log1p_safe, number, per_acre, round_half_up, worked_out
from terrier.operators import ranks
from terrier.operators.spatial import nearest
from terrier.sources.scratch import written

#: Fixed values.
MIN_PEERS, MAD_SCALE, K = 12, 0.6745, 25
CATALOGUE = 25
#: What is scored against whom.
METRICS = {
    "town": ("taxable", ["peer_town", "vacant"]),
    "town_vpa": ("taxable_per_acre", ["peer_town", "vacant"]),
    "band": ("taxable", ["peer_town", "vacant", "band"]),
    "band_vpa": ("taxable_per_acre", ["peer_town", "vacant", "band"]),
}


def build_features(parcels: DataFrame) -> DataFrame:
    """parcels (parcel_id, ordinal, township, land_text, building_text, taxable_text, exemption_text, acres_text, allocation, joined) with numbers, sums, per-acre values and flags added. Lots that carry a copied value have no per-acre values; missing stays missing."""
    out = parcels.select("*", *[number(F.col(f"{c}_text")).alias(c) for c in ("land", "building", "taxable", "exemption", "acres")])
    lot_level = F.col("joined") & (F.coalesce("allocation", F.lit("")) != "copied_full_assessment")
    return out.select(
        "*",
        (F.col("land") + F.col("building")).alias("land_building"),
        (F.col("taxable") - F.col("land") - F.col("building")).alias("taxable_less_parts"),
        *[F.when(lot_level, per_acre(F.col(c), F.col("acres"))).alias(f"{c}_per_acre") for c in ("taxable", "land", "building")],
        F.when(F.col("land") > 0, F.col("building") / F.col("land")).alias("building_land_ratio"),
        F.coalesce(F.col("joined") & (F.col("building") == 0), F.lit(False)).alias("vacant"),
        (~F.col("joined")).alias("unjoined"),
        acreage_band(F.col("acres")).alias("band"),
    )


def skip_reason() -> Column:
    return F.when(F.col("unjoined"), "unjoined").when(F.col("allocation") == "copied_full_assessment", "copied_full_assessment").when(F.col("taxable").isNull(), "no_taxable_value")


def robust_scores(rows: DataFrame, metrics: dict[str, tuple[str, list[str]]], at_least: int = MIN_PEERS, spread: bool = True) -> DataFrame:
    """rows with, for each prefix of metrics (prefix: value column and group keys), <prefix>_n, _expected (median of the group), _residual, _percentile (share of the group strictly below), _mad (robust z of log1p) and _repeated added. Groups of fewer than `at_least` values have no percentile and no z. Rows without the value get the group's n and median. Without `spread` there are no _mad and _repeated, which take a second pass over the counts.

    Worked out for all metrics at once from counts per value, which are written once; no task holds a group (see ranks)."""
    names = list(dict.fromkeys(k for _, keys in metrics.values() for k in keys))
    types = {k: rows.schema[k].dataType for k in names}
    views = [F.struct(F.lit(p).alias("metric"), *[(F.col(k) if k in keys else F.lit(None).cast(types[k])).alias(k) for k in names], F.col(x).cast("double").alias("value")) for p, (x, keys) in metrics.items()]
    keys = ["metric", *names]
    counts = rows.select(F.explode(F.array(*views)).alias("m")).select("m.*").where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    # Written before they are placed, which reads them twice.
    places = written(ranks.placed(written(counts, "counts"), keys), "places")
    mids = ranks.middles(places, keys).select(*keys, "total", ranks.half_way(F.col("low"), F.col("high")).alias("expected"), ranks.half_way(log1p_safe(F.col("low")), log1p_safe(F.col("high"))).alias("mid"))
    if spread:
        gaps = ranks.keyed(places.select(*keys, "value", "n"), mids.select(*keys, "mid"), keys).groupBy(*keys, F.abs(log1p_safe(F.col("value")) - F.col("mid")).alias("value")).agg(F.sum("n").alias("n"))
        mids = ranks.keyed(mids, ranks.middles(ranks.placed(gaps, keys), keys).select(*keys, ranks.half_way(F.col("low"), F.col("high")).alias("spread")), keys)
    groups = written(mids if spread else mids.withColumn("spread", F.lit(None).cast("double")), "groups")
    out = rows
    for prefix, (metric, own) in metrics.items():
        mine = F.col("metric") == prefix
        out = ranks.keyed(out, groups.where(mine).select(*own, *[F.col(c).alias(f"_{c}") for c in ("total", "expected", "mid", "spread")]), own, "left")
        out = ranks.by_value(out, places.where(mine).select(*own, "value", F.col("below").alias("_below")), own, metric)
        x, n, wide = F.col(metric), F.coalesce("_total", F.lit(0)), F.col("_spread")
        powered = (n >= at_least) & x.isNotNull()
        out = out.withColumns(
            {
                f"{prefix}_n": n,
                f"{prefix}_expected": F.col("_expected"),
                f"{prefix}_residual": x - F.col("_expected"),
                f"{prefix}_percentile": F.when(powered, F.col("_below") / n),
                f"{prefix}_mad": F.when(powered & (wide > 0), MAD_SCALE * (log1p_safe(x) - F.col("_mid")) / wide),
                f"{prefix}_repeated": F.coalesce(powered & (wide == 0), F.lit(False)),
            }
        ).drop("_total", "_expected", "_mid", "_spread", "_below")
    return out if spread else out.drop(*[f"{p}_{f}" for p in metrics for f in ("mad", "repeated")])


def peer_scores(features: DataFrame, prefixes: tuple[str, ...] = tuple(METRICS), spread: bool = True, held: bool = False) -> DataFrame:
    """Scores of taxable value and of value per acre against the township and against the township's acreage band, vacant and improved apart. Only rows without a skip_reason() take part; those without a band have no peers in one. `prefixes` names those of METRICS that are wanted; features that are `held`, written already, are not written again."""
    pool = features.where(skip_reason().isNull()).withColumn("peer_town", F.coalesce("township", F.lit("_none")))
    pool = pool if held else written(pool, "pool")
    out = robust_scores(pool, {p: METRICS[p] for p in prefixes}, spread=spread)
    no_band = [c for c in out.columns if c.startswith("band_")]
    return out.select(*[c for c in out.columns if c not in no_band], *[F.when(F.col("band").isNotNull(), F.col(c)).otherwise(F.lit(0) if c.endswith("_n") else F.lit(False) if c.endswith("_repeated") else F.lit(None)).alias(c) for c in no_band])


def preferred(*metrics: str, field: str, at_least: int = MIN_PEERS) -> Column:
    """The field of the first metric whose peers are enough."""
    return F.coalesce(*[F.when(F.col(f"{m}_n") >= at_least, F.col(f"{m}_{field}")) for m in metrics])


def knn_scores(features: DataFrame, neighbours: DataFrame) -> DataFrame:
    """features scored against their nearest peers. neighbours (parcel_id, neighbour_id): peers that are themselves scored; rows without any have none."""
    pool = features.where(skip_reason().isNull())
    peers = neighbours.join(pool.select(F.col("parcel_id").alias("neighbour_id"), F.col("taxable").alias("peer_taxable")), "neighbour_id")
    joined = pool.select("parcel_id", "vacant", "taxable").join(peers, "parcel_id", "left")
    mid = joined.groupBy("parcel_id", "vacant", "taxable").agg(F.count("peer_taxable").alias("knn_n"), F.median("peer_taxable").alias("knn_expected"), F.count_if(F.col("peer_taxable") < F.col("taxable")).alias("below"), F.collect_list(log1p_safe(F.col("peer_taxable"))).alias("logs"), F.median(log1p_safe(F.col("peer_taxable"))).alias("mid"))
    # At most K values a row.
    gaps = F.array_sort(F.transform("logs", lambda v: F.abs(v - F.col("mid"))))
    half = F.floor(F.size("logs") / 2).cast("int")
    spread = F.when(F.size("logs") % 2 == 1, F.get(gaps, half)).otherwise((F.get(gaps, half - 1) + F.get(gaps, half)) / 2)
    powered = F.col("knn_n") >= MIN_PEERS
    z = MAD_SCALE * (log1p_safe(F.col("taxable")) - F.col("mid"))
    return mid.withColumn("spread", spread).select(
        "parcel_id", "vacant", "taxable", "knn_n", "knn_expected", (F.col("taxable") - F.col("knn_expected")).alias("knn_residual"), F.when(powered, F.col("below") / F.col("knn_n")).alias("knn_percentile"),
        F.when(powered & (F.col("spread") > 0), z / F.col("spread")).alias("knn_mad"), F.coalesce(powered & (F.col("spread") == 0), F.lit(False)).alias("knn_repeated"),
    )


def with_nearest(scores: DataFrame, k: int = K) -> DataFrame:
    """scores (with x and y, a place of each parcel) with the fields of knn_scores() where band and township are too thin: against the k nearest of all scored parcels of the same occupancy, whatever their township. Only thin rows ask."""
    held = written(scores, "scores")
    thin = (F.col("band_n") < MIN_PEERS) & (F.col("town_n") < MIN_PEERS)
    near = nearest(held.select(F.col("parcel_id").alias("id"), "x", "y", "vacant", thin.alias("thin")), k, part="vacant", asks="thin")
    asked = near.select(F.col("id").alias("parcel_id"), "neighbour_id")
    peers = asked.join(held.select(F.col("parcel_id").alias("neighbour_id"), "taxable"), "neighbour_id")
    # The peers' values and the thin rows' own are all that knn_scores() needs.
    values = held.where(thin).select("parcel_id", "vacant", "taxable").unionByName(peers.select(F.col("neighbour_id").alias("parcel_id"), F.lit(None).cast("boolean").alias("vacant"), "taxable")).dropDuplicates(["parcel_id"])
    scored = knn_scores(values.select("*", F.lit(False).alias("unjoined"), F.lit("single_lot").alias("allocation")), asked)
    return held.join(scored.join(asked.select("parcel_id").distinct(), "parcel_id", "left_semi").drop("vacant", "taxable"), "parcel_id", "left")


#: Peers in the order in which they are preferred, with what they are called.
PREFERRED = {"band": "acreage_band", "town": "township", "knn": "knn"}


def _preferred(scores: DataFrame, field: str) -> Column:
    return preferred(*[p for p in PREFERRED if f"{p}_n" in scores.columns], field=field)


def _peer_kind(scores: DataFrame) -> Column:
    return F.coalesce(*[F.when(F.col(f"{p}_n") >= MIN_PEERS, name) for p, name in PREFERRED.items() if f"{p}_n" in scores.columns])


def catalogue(scores: DataFrame, highest: bool, size: int = CATALOGUE) -> DataFrame:
    """The rows with the largest (or smallest) residual against their preferred peers: those of band, township or, with with_nearest(), the nearest."""
    pick = lambda f: _preferred(scores, f)
    rows = scores.select("parcel_id", "township", "vacant", F.col("taxable").alias("observed"), pick("expected").alias("expected"), pick("residual").alias("residual"), pick("percentile").alias("percentile"), _peer_kind(scores).alias("peer_kind"), pick("n").alias("peer_n")).where("residual is not null")
    return rows.orderBy(F.col("residual").desc() if highest else F.col("residual").asc(), "parcel_id").limit(size)


def explain(scores: DataFrame) -> DataFrame:
    """What is told of each row's value and its preferred peers, in a fixed wording; null without any. The preferred peers' fields are worked out once a row, as each is a choice of three."""
    fields = [_preferred(scores, f).alias(f"_{f}") for f in ("n", "expected", "residual", "percentile", "mad", "repeated")]
    told = worked_out(scores, _peer_kind(scores).alias("_kind"), *fields)
    pick = lambda f: F.col(f"_{f}")
    dollars = lambda x: F.concat(F.lit("$"), F.format_number(round_half_up(x).cast("long"), 0))
    shown = lambda x, places: F.call_function("format_number", x, F.lit(f"0.{'0' * places}"))  # noqa: E731  much faster than format_string()
    kind = F.col("_kind")
    peers = F.when(kind == "acreage_band", F.concat(F.lit(" acreage band "), band_label(F.col("band")))).when(kind == "knn", " (k-nearest comparable parcels)").otherwise("")
    share = F.coalesce(shown(round_half_up(pick("percentile") * 1000) / 10, 1), F.lit("n/a"))
    deviation = F.when(pick("repeated"), "repeated-value class (MAD=0)").otherwise(F.coalesce(shown(round_half_up(pick("mad") * 100) / 100, 2), F.lit("n/a")))
    sentence = F.concat(
        F.lit("Parcel "), F.col("parcel_id"), F.lit(" taxable value is "), dollars(F.col("taxable")), F.lit(". Expected (median of "), pick("n").cast("string"), F.when(F.col("vacant"), " vacant").otherwise(" improved"), F.lit(" parcels in "),
        F.coalesce("township", F.lit("unknown township")), peers, F.lit(") is "), dollars(pick("expected")), F.lit(". Residual "), dollars(pick("residual")), F.lit(". Peer percentile "), share, F.lit(". MAD(log taxable) "), deviation,
        F.lit(". This is a comparison to an appropriate peer group, not a finding of error or wrongdoing."),
    )
    return told.select("parcel_id", F.when(kind.isNotNull(), sentence).alias("explanation"))


def average_rank_percent(rows: DataFrame, cohorts: list[str], value: str, out: str) -> DataFrame:
    """Percent from 0 to 100 within cohorts, ties at their average rank, a lone row at 50; -1 where the value is missing. Worked out from counts per value, as cohorts may be few and hold all rows."""
    places = ranks.placed(written(ranks.value_counts(rows, cohorts, value), "values"), cohorts)
    place, total = F.col("below") + (F.col("n") - 1) / 2, F.col("total")
    percent = F.when(total == 1, 50).otherwise(F.floor(100 * place / F.nullif(total - 1, F.lit(0)) + 0.5)).cast("int")
    return ranks.by_value(rows, places.select(*cohorts, "value", percent.alias(out)), cohorts, value).withColumn(out, F.coalesce(out, F.lit(-1)))


def upper_medians(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys and the middle value of each group, of an even number the upper of the two: not averaged."""
    places = ranks.placed(written(ranks.value_counts(rows, keys, value), "values"), keys)
    return ranks.middles(places, keys).select(*keys, F.col("high").alias(out))
