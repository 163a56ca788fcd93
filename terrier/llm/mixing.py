"""Mixing sources to target weights, with DataFrame operations only.

Words are summed by source; each source's target is its share of the mix by weight, at most `limit` times its size; a
document is then emitted floor(rate) times, where rate is target over size, plus one hash-seeded Bernoulli copy with a
probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import WORD, fresh, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"
#: Tables of so many sources at most are broadcast; a longer one is joined by key.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only the key and the seed determine: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sizes (source, source_size): one row a source. Adds target and rate (target / source_size, 0 for an empty source).

    Sources in order of code point, null last, weigh as `weights` repeat. The mix holds `share` times all sizes. A
    target above `limit` times its source's size stops there and the excess is reshared by weight until none is above:
    with sources in order of size / weight, those that stop are a prefix, so that running sums find the level at once.
    Needs share <= limit. The windows hold one row a source, not documents."""
    if share > limit:
        raise ValueError("the share must not exceed the limit, or no targets can reach it")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight)
    cap = limit * F.col("source_size")
    w = w.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("total", share * F.sum("source_size").over(all_rows))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    )
    # The first source whose cap lies above its share of what is left, and all after it, stay at that level.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_rows)
    w = w.withColumn("level", level["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return w.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select("source", "source_size", "target", "rate")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """docs with mix_size (words of the text; null: 0), mix_source_size, mix_target and mix_copies (how often the document is emitted) added; underscores are appended to a name that is taken.

    Copies of a row get the same number of copies. An empty table gives an empty one. Sums are taken before the shuffle,
    so a hot source costs no more than another; the table of targets is counted, and broadcast only if it is short."""
    size, total, target, rate, copies, key = fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "mix_key")
    # A null source is a source of its own; the prefix keeps it apart from any name.
    name = F.when(F.col(source_col).isNotNull(), F.concat(F.lit("s"), F.col(source_col).cast("string"))).otherwise("n")
    sized = docs.withColumn(size, word_count(F.col(text_col))).withColumn(key, name)
    sizes = sized.groupBy(key).agg(F.sum(size).alias("source_size")).select(F.when(F.col(key) != "n", F.substring(key, 2, 2**31 - 1)).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, limit).select(F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source"))).otherwise("n").alias(key), F.col("source_size").alias(total), F.col("target").alias(target), F.col("rate").alias(rate))
    targets = written(targets, "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    whole = F.floor(rate)
    extra = (unit_hash(F.col(id_col), seed) < F.col(rate) - whole).cast("long")
    return sized.join(targets, key).withColumn(copies, whole + extra).drop(key, rate)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as plan_mix says, with the columns of docs."""
    planned = plan_mix(docs, id_col, text_col, source_col, **how)
    copies, turn = [c for c in planned.columns if c not in docs.columns][-1], fresh(planned, "turn")[0]
    return planned.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[planned[c] for c in docs.columns])
