"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.sources.scratch import drop_written, written


def _star(links: DataFrame) -> DataFrame:
    """links (node, other): each node's smallest neighbour, itself included, beside each of its links. The minimum is taken with partial sums, and the join has one row a node on one side, so a node with very many links is split."""
    least = links.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return links.join(least, "node")


def _round(links: DataFrame) -> DataFrame:
    """A large and a small star. Each star is read once and told both ways by inline(): a union of two readings would double the plan with every step."""
    ways = lambda *pairs: F.inline(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in pairs]))
    both = links.select(ways(("node", "other"), ("other", "node")))
    large = _star(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).where("node != other").distinct()
    down = large.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    return _star(down).select(ways(("other", "least"), ("node", "least"))).where("node != other").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node that has a link to another: component is the smallest node reachable.

    Alternates large and small stars, which takes about as many rounds as the logarithm of the longest path. The links
    of each round are written to the shared folder; only their number and a checksum reach the driver. Links with a
    null end or to itself don't count; an empty table gives an empty one. Nodes may be of any ordered type."""
    spark = links.sparkSession
    now = written(links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node != other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first()
        if seen == mark or not seen[0]:
            roots = now.select(F.col("other").alias("node"), "other").distinct()
            return now.select("node", "other").union(roots).withColumnRenamed("other", "component")
        mark, before = seen, now
        now = written(_round(before), "links")
        drop_written(spark, before)
