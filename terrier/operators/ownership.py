"""Owners: entities, shares, concentration, and the graph of what relates them. Similar names are linked, never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions.names import can_reach, jaro_winkler, token_sorted
from terrier.functions.owners import AGENCIES, is_institution, owner_kind
from terrier.sources.scratch import written

#: Fixed values.
SIMILAR, DEPTH, EXAMPLES = 0.92, 10, 3


def _sum(c: str) -> Column:
    return F.sum(F.coalesce(c, F.lit(0.0)))


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Acres and taxable value of all rows, owned or not; missing counts as 0 in sums."""
    return rows.groupBy(*keys).agg(_sum("acres").alias("total_acres"), _sum("taxable").alias("total_taxable"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def town_shares(rows: DataFrame, parcels: Column | None = None) -> DataFrame:
    """rows (owner, township, acres, taxable): an owner's parcels, sums and shares in each township. parcels: how they are counted, if a row isn't one."""
    each = rows.where("owner is not null and township is not null").groupBy("owner", "township").agg((F.count("*") if parcels is None else parcels).alias("parcels"), _sum("acres").alias("acres"), _sum("taxable").alias("taxable"))
    out = each.join(totals(rows.where("township is not null"), "township"), "township")
    return out.select("owner", "township", "parcels", "acres", "taxable", _share(F.col("acres"), F.col("total_acres")).alias("acre_share"), _share(F.col("taxable"), F.col("total_taxable")).alias("taxable_share"))


def entities(rows: DataFrame) -> DataFrame:
    """One row an owner: kind, institution, first raw spellings, counts, sums, shares of all and largest township share. Rows are read once: sums per owner, spelling and township are written, and all else is made of these, so an owner of very many parcels is summed before it meets itself."""
    held = written(rows.groupBy("owner", "owner_raw", "township").agg(F.count("*").alias("parcels"), _sum("acres").alias("acres"), _sum("taxable").alias("taxable"), F.min("ordinal").alias("ordinal")), "held")
    known = held.where("owner is not null")
    shares = town_shares(held, F.sum("parcels")).groupBy("owner").agg(F.count("*").alias("townships"), F.max("acre_share").alias("max_town_share"))
    spelt = known.groupBy("owner", "owner_raw").agg(F.min("ordinal").alias("first"))
    turn = F.row_number().over(Window.partitionBy("owner").orderBy("first", "owner_raw"))
    raw = spelt.withColumn("turn", turn).where(F.col("turn") <= EXAMPLES).groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "owner_raw"))), lambda s: s["owner_raw"]), ";").alias("examples"))
    each = known.groupBy("owner").agg(F.sum("parcels").alias("parcels"), _sum("acres").alias("acres"), _sum("taxable").alias("taxable"))
    out = each.join(shares, "owner", "left").join(raw, "owner").crossJoin(F.broadcast(totals(held)))  # the totals are one row
    return out.select("owner", owner_kind(F.col("owner")).alias("kind"), is_institution(F.col("owner")).alias("institution"), "examples", "parcels", "acres", "taxable", F.coalesce("townships", F.lit(0)).alias("townships"), "max_town_share", _share(F.col("acres"), F.col("total_acres")).alias("acre_share"), _share(F.col("taxable"), F.col("total_taxable")).alias("taxable_share"))


def concentration(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The owners with most acres and most taxable value, of all and of each township: scope, scope_id, metric, rank, owner, value, share. Ties go to the owner with more acres in all, then by name."""
    shares, whole = town_shares(rows), rows.where("owner is not null").groupBy("owner").agg(_sum("acres").alias("all_acres"), _sum("taxable").alias("all_taxable"))
    town = shares.join(whole.select("owner", "all_acres"), "owner")
    stack = lambda df, scope, scope_id, a, t, sa, st: df.select("owner", "all_acres", F.lit(scope).alias("scope"), scope_id.alias("scope_id"), F.explode(F.array(F.struct(F.lit("acres").alias("metric"), a.alias("value"), sa.alias("share")), F.struct(F.lit("taxable").alias("metric"), t.alias("value"), st.alias("share")))).alias("m")).select("owner", "all_acres", "scope", "scope_id", "m.*")
    c = F.col
    everyone = whole.crossJoin(F.broadcast(totals(rows)))
    both = stack(town, "township", c("township"), c("acres"), c("taxable"), c("acre_share"), c("taxable_share")).unionByName(stack(everyone, "all", F.lit("all"), c("all_acres"), c("all_taxable"), _share(c("all_acres"), c("total_acres")), _share(c("all_taxable"), c("total_taxable"))))
    turn = F.row_number().over(Window.partitionBy("scope", "scope_id", "metric").orderBy(c("value").desc(), c("all_acres").desc(), F.expr("owner collate UNICODE")))
    return both.withColumn("rank", turn).where(c("rank") <= depth).select("scope", "scope_id", "metric", "rank", "owner", "value", "share")


def knn_share(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """owner, share: the largest share of acres that an owner has in the neighbourhood of one of its parcels. neighbours (id, neighbour_id) without the parcel itself."""
    held = rows.select(F.col("parcel_id").alias("neighbour_id"), F.col("owner").alias("other"), F.coalesce("acres", F.lit(0.0)).alias("a"))
    own = rows.where("owner is not null").select(F.col("parcel_id").alias("id"), "owner")
    around = neighbours.select("id", "neighbour_id").unionByName(rows.select(F.col("parcel_id").alias("id"), F.col("parcel_id").alias("neighbour_id")))
    sums = own.join(around, "id").join(held, "neighbour_id").groupBy("id", "owner").agg(F.sum(F.when(F.col("other") == F.col("owner"), F.col("a")).otherwise(0.0)).alias("same"), F.sum("a").alias("total"))
    return sums.where("total > 0").groupBy("owner").agg(F.max(F.col("same") / F.col("total")).alias("share"))


def candidate_pairs(rows: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Owners (a < b) who share a township or a mail address or whose parcels touch: a, b, same_town, same_mail, adjacent. rows (owner, township, mail); adjacent (a, b)."""

    def share(key: str, flag: str) -> DataFrame:
        each = rows.where(f"owner is not null and {key} is not null").select("owner", key).distinct()
        left, right = each.select(F.col("owner").alias("a"), key), each.select(F.col("owner").alias("b"), key)
        return left.join(right, key).where("a < b").select("a", "b").distinct().withColumn("flag", F.lit(flag))

    every = share("township", "town").unionByName(share("mail", "mail")).unionByName(adjacent.select("a", "b").distinct().withColumn("flag", F.lit("adjacent")))
    has = lambda f: F.bool_or(F.col("flag") == f)
    # Written, so that what is asked of a pair's names is asked once a pair: a filter on them would be pushed down to every touch.
    return written(every.groupBy("a", "b").agg(has("town").alias("same_town"), has("mail").alias("same_mail"), has("adjacent").alias("adjacent")), "candidates")


def is_agency_variant(a: Column, b: Column) -> Column:
    """Whether the longer name is the shorter one and an agency's initials."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != b) & F.startswith(long, short) & F.trim(F.substr(long, F.length(short) + 1)).isin(*AGENCIES)


def similar_edges(pairs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Of candidate pairs: agency variants as possible_related, others whose names with sorted words are similar enough as similar_name; with score and flags."""
    named = pairs.withColumns({"x": token_sorted(F.col("a")), "y": token_sorted(F.col("b")), "agency": is_agency_variant(F.col("a"), F.col("b"))})
    scored = named.where(F.col("agency") | can_reach(F.col("x"), F.col("y"), threshold)).withColumn("score", jaro_winkler(F.col("x"), F.col("y"))).drop("x", "y")
    kind = F.when(F.col("agency"), "possible_related").when(F.col("score") >= threshold, "similar_name")
    return scored.withColumn("type", kind).where("type is not null").drop("agency")


def agency_edges(owners: DataFrame) -> DataFrame:
    """owners (owner): all pairs (a, b) of a name and the same name with an agency's initials, found by joining on the name without them."""
    names = owners.select("owner").where("owner is not null").distinct()
    ends = F.array(*[F.lit(s + agency) for agency in AGENCIES for s in ("", " ")])
    stems = names.select(F.col("owner").alias("long"), F.explode(F.filter(ends, lambda e: F.endswith(F.col("owner"), e))).alias("end")).select("long", F.expr("substr(long, 1, length(long) - length(end))").alias("owner")).where("owner != ''")
    return names.join(stems, "owner").select(F.least("owner", "long").alias("a"), F.greatest("owner", "long").alias("b")).distinct()


def adjacent_edges(pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """pairs (id, neighbour_id, oa, ob) of touching parcels and their owners, those of one owner (same_owner) and those of two with similar names (similar_name), from edges (a, b)."""
    same = pairs.where("oa = ob").select("id", "neighbour_id", F.lit(True).alias("same_owner"), F.lit(False).alias("similar_name"))
    across = pairs.where("oa != ob").select("id", "neighbour_id", F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))
    return same.unionByName(across.join(similar.select("a", "b").distinct(), ["a", "b"]).select("id", "neighbour_id", F.lit(False).alias("same_owner"), F.lit(True).alias("similar_name")))


def same_mail_edges(rows: DataFrame) -> DataFrame:
    each = rows.where("owner is not null and mail is not null").select("owner", "mail").distinct()
    return each.select(F.col("owner").alias("a"), "mail").join(each.select(F.col("owner").alias("b"), "mail"), "mail").where("a < b").select("a", "b", "mail")


def group_edges(rows: DataFrame) -> DataFrame:
    """rows (parcel_id, group_id, allocation): pairs of parcels of one multi-lot group, and again as copied_assessment where either carries a copied value."""
    each = rows.where("group_id is not null").select("group_id", "parcel_id", F.coalesce(F.col("allocation") == "copied_full_assessment", F.lit(False)).alias("copied"))
    a, b = (each.select("group_id", F.col("parcel_id").alias(i), F.col("copied").alias(f"{i}_copied")) for i in ("a", "b"))
    pairs = a.join(b, "group_id").where("a < b")
    kinds = F.when(F.col("a_copied") | F.col("b_copied"), F.array(F.lit("same_property_id"), F.lit("copied_assessment"))).otherwise(F.array(F.lit("same_property_id")))
    return pairs.select(F.explode(kinds).alias("type"), "a", "b")


def graph_nodes(rows: DataFrame) -> DataFrame:
    """id and type of sources, parcels, townships, sheets, mails, owner strings and owners; each once."""
    kinds = (("source", F.when(F.col("joined"), "valuation").otherwise("geometry")), ("parcel", F.col("parcel_id")), ("township", F.col("township")), ("map_sheet", F.col("sheet")), ("mail", F.col("mail")), ("owner_string", F.col("owner_raw")), ("normalized_owner", F.col("owner")))
    each = rows.select(F.explode(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(t).alias("type"), c.alias("key"))) for t, c in kinds])).alias("n")).where("n is not null")
    return each.select("n.type", F.concat_ws(":", "n.type", "n.key").alias("id")).distinct()


def structural_edges(rows: DataFrame) -> DataFrame:
    """type, source, target of what each row says: where it comes from, lies and files, who owns it, and which owner a spelling is."""
    parcel, node = F.concat(F.lit("parcel:"), "parcel_id"), lambda t, c: F.concat(F.lit(f"{t}:"), c)
    edges = (("from_source", parcel, node("source", F.when(F.col("joined"), "valuation").otherwise("geometry"))), ("in_township", parcel, node("township", F.col("township"))), ("on_map_sheet", parcel, node("map_sheet", F.col("sheet"))), ("owns", node("owner_string", F.col("owner_raw")), parcel), ("normalizes_to", node("owner_string", F.col("owner_raw")), node("normalized_owner", F.col("owner"))))
    each = rows.select(F.explode(F.array(*[F.when(s.isNotNull() & t.isNotNull(), F.struct(F.lit(k).alias("type"), s.alias("source"), t.alias("target"))) for k, s, t in edges])).alias("e")).where("e is not null")
    return each.select("e.*").distinct()
