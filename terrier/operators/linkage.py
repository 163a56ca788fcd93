"""Record linkage: last, first or best row of a key, a ladder of candidate keys, filling gaps, and overriding by later records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions.lots import is_suffix_parent, lot_candidates, lot_key
from terrier.functions.owners import is_owner, roughly_same
from terrier.functions.values import is_money

#: What a match that rests on less is worth.
PARENT_CONFIDENCE, CARD_CONFIDENCE = 0.55, 0.35


def one_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order. Rows are limited before the shuffle too, so a key with very many rows doesn't gather them."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("turn = 1").drop("turn")


def last_wins(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return one_per_key(rows, [key], F.col(ordinal).desc())


def first_wins(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return one_per_key(rows, [key], F.col(ordinal).asc())


def best_wins(rows: DataFrame, key: str, score: str, ordinal: str = "ordinal") -> DataFrame:
    """Of equal scores the first."""
    return one_per_key(rows, [key], F.col(score).desc_nulls_last(), F.col(ordinal).asc())


def join_last(left: DataFrame, right: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """left with the columns of the last row of right that has its key, case aside; null where none has."""
    fold = F.upper(F.col(key))
    once = last_wins(right.withColumn("fold", fold), "fold", ordinal).drop(key, ordinal)
    return left.withColumn("fold", fold).join(once, "fold", "left").drop("fold")


def join_by_ladder(geometry: DataFrame, tax: DataFrame) -> DataFrame:
    """geometry (id, geocode, lot) with the tax record that the first fitting candidate of its lot leads to.

    tax (tax_id, geocode, tax_lot, owner, total, confidence, ordinal). Each record is filed under all candidates of its
    own lot, where the most confident stays, of equals the first. A candidate fits if its record has a valid owner and,
    for all but the first, is filed for a lot that the geometry's is a unit of. Adds tax_id, owner, total, method and
    join_confidence."""
    filed = tax.select("*", F.explode(lot_candidates(F.col("tax_lot"))).alias("candidate")).withColumn("key", lot_key(F.col("geocode"), F.col("candidate"))).drop("geocode", "candidate")
    filed = best_wins(filed, "key", "confidence").where(is_owner(F.col("owner"))).drop("ordinal")
    tried = geometry.select("id", "geocode", "lot", F.posexplode(lot_candidates(F.col("lot"))).alias("step", "candidate")).withColumn("key", lot_key(F.col("geocode"), F.col("candidate")))
    hits = tried.join(filed, "key").where((F.col("step") == 0) | is_suffix_parent(F.col("lot"), F.col("tax_lot")))
    found = one_per_key(hits, ["id"], F.col("step").asc())
    method = F.when(F.col("step") == 0, "map_lot").when(F.col("step") > 0, "map_lot_parent").otherwise("unjoined")
    score = F.when((F.col("step") > 0) & ~is_money(F.col("total")), PARENT_CONFIDENCE).otherwise(F.col("confidence"))
    out = geometry.join(found.select("id", "step", "tax_id", "owner", "total", "confidence"), "id", "left")
    return out.select(*geometry.columns, "tax_id", "owner", "total", method.alias("method"), score.alias("join_confidence"))


def fill_owners(parcels: DataFrame, cards: DataFrame) -> DataFrame:
    """parcels (lot, owner, account, method, join_confidence) with owners from cards (lot, card_owner, card_account, ordinal) where none is valid. Lots whose cards disagree on the owner fill nothing; nothing valid is overwritten."""
    known = cards.where("lot is not null and coalesce(card_owner, '') != ''")
    agreed = known.groupBy("lot").agg(F.count_distinct(F.upper("card_owner")).alias("spellings"), F.min_by(F.struct("card_owner", "card_account"), "ordinal").alias("card")).where("spellings = 1").select("lot", "card")
    joined = parcels.join(agreed, "lot", "left")
    fills = ~is_owner(F.col("owner")) & F.col("card").isNotNull()
    given = {"owner": F.col("card.card_owner"), "account": F.coalesce("account", "card.card_account"), "method": F.lit("property_card"), "join_confidence": F.lit(CARD_CONFIDENCE)}
    return joined.select(*[F.when(fills, given[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in parcels.columns])


def fill_counts(parcels: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: eligible, filled, collisions."""
    lots = cards.where("lot is not null and coalesce(card_owner, '') != ''").groupBy("lot").agg(F.count_distinct(F.upper("card_owner")).alias("n"))
    need = parcels.where(~is_owner(F.col("owner")) & (F.coalesce("lot", F.lit("")) != ""))
    a = need.join(lots, "lot", "left").agg(F.count("*").alias("eligible"), F.count_if(F.col("n") == 1).alias("filled"))
    return a.crossJoin(F.broadcast(lots.agg(F.count_if(F.col("n") > 1).alias("collisions"))))  # one row each


def override(index: DataFrame, transfers: DataFrame) -> DataFrame:
    """index (key, owner) with later transfers (key, new_owner, date, ordinal): the latest of each key confirms a name that is roughly the same, else replaces it, and stands alone where the index has none. Adds source, transfer_date and outcome."""
    latest = one_per_key(transfers, ["key"], F.col("date").desc_nulls_last(), F.col("ordinal").asc())
    both = index.join(latest, "key", "full")
    same = roughly_same(F.col("owner"), F.col("new_owner"))
    outcome = F.when(F.col("new_owner").isNull(), "index").when(F.col("owner").isNull(), "insert").when(same, "confirm").otherwise("override")
    out = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("insert", "override")
    return out.select("key", F.when(taken, F.col("new_owner")).otherwise(F.col("owner")).alias("owner"), F.when(taken, "transfer").otherwise("index").alias("source"), F.when(F.col("outcome") != "index", F.col("date")).alias("transfer_date"), "outcome")


def validate_against_index(tax: DataFrame, index: DataFrame) -> DataFrame:
    """tax (property_id, key) against index (property_id, key): one row a tax row with matched, same_key and orphan."""
    ids = index.groupBy("property_id").agg(F.collect_set("key").alias("keys"))
    out = tax.join(ids, "property_id", "left")
    return out.select(*tax.columns, F.col("keys").isNotNull().alias("matched"), F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False)).alias("same_key"))


def replace_group(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """old without the groups that new brings, and new."""
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key it doesn't bring."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def write_back(tax: DataFrame, matches: DataFrame) -> DataFrame:
    """tax (tax_id) with geometry_id, the geometry of the last of its matches (tax_id, geometry_id, ordinal), null without any; matches of no tax row count for nothing."""
    last = matches.where("tax_id is not null").groupBy("tax_id").agg(F.max_by("geometry_id", "ordinal").alias("geometry_id"))
    return tax.drop("geometry_id").join(last, "tax_id", "left")


def patch_stats(stats: DataFrame, rows: DataFrame, key: str, **measured: Column) -> DataFrame:
    """stats (key, ...) with those columns that are measured anew on rows replaced; batches without rows, and columns that aren't measured, stay. Batches that stats doesn't know are left out."""
    fresh = rows.groupBy(key).agg(*[c.alias(f"new_{n}") for n, c in measured.items()])
    out = stats.join(fresh, key, "left")
    return out.select(key, *[F.coalesce(f"new_{c}", c).alias(c) if c in measured else c for c in stats.columns if c != key])


def coverage_manifest(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """A row for each group and one (`*`) for all: n, how many rows pass each test, and the share of them."""
    counts = [F.count("*").alias("n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()]]
    every = rows.withColumn(key, F.coalesce(key, F.lit("_none"))).rollup(key).agg(*counts)
    return every.select(F.coalesce(key, F.lit("*")).alias(key), "n", *tests, *[F.round(F.col(t) / F.col("n"), 6).alias(f"{t}_rate") for t in tests]).where("n > 0")
