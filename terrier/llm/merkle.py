"""Merkle dataset manifest: a postorder append log with proofs.

Each language's rows are the leaves of a tree, the trees' tops those of one more. A tree is cut into aligned segments of
2**SPAN leaves, and a builder appends a segment's nodes in the order in which they are complete; the segments' tops are
the leaves of the next round, until each tree has one top. In that order a node's position follows from its level and
index alone: before leaf i lie 2i - popcount(i) nodes, as every subtree of 2**k leaves has 2**(k+1) - 1. So a proof finds
its siblings by arithmetic: those within the segment, then those of the segment's top, which all its leaves share.

No task holds more than a segment. Rows are numbered by a range sort and running counts of its partitions, however many
of them one language or one id has. A row's null fields count as `-`; a null language is a tree of its own, the first;
a null id comes first within its tree, and rows of one id follow by leaf, so equal rows are leaves side by side. An empty
table has no tree and gives no row. Columns other than the five hashed are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import written

#: Levels of a segment. Its log has fewer than 2**(SPAN+1) digests of 32 bytes.
SPAN = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree string, block long, n long, nodes binary, digest string"


def nodes_at(level: int, leaves: int) -> int:
    return (leaves + (1 << level) - 1) >> level


def height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Of a node in the log of a tree: after all that is complete before its last leaf, and after its own lower levels."""
    last = min((index + 1) << level, leaves) - 1
    return 2 * last - last.bit_count() + level


def subtree_size(level: int, index: int, leaves: int) -> int:
    """Nodes of the subtree under a node, itself included; they lie side by side and end with it."""
    first = index << level
    return position(level, index, leaves) - (2 * first - first.bit_count()) + 1


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes up to `levels`, each as soon as it is complete; digests are hashed as hex text."""
    log, waiting = [], [b""] * levels
    for i, node in enumerate(leaves):
        log.append(node)
        for level in range(levels):
            if i >> level & 1:
                node = sha256((waiting[level].hex() + node.hex()).encode()).digest()
            elif i == len(leaves) - 1:
                node = sha256(node.hex().encode()).digest()
            else:
                waiting[level] = node
                break
            log.append(node)
    return log


def _levels(leaves: int, span: int) -> int:
    """Of a segment: all, or those of the whole tree if it has just one."""
    return span if leaves > 1 << span else height(leaves)


def _builder(span: int):
    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table["n"][0].as_py()
        log = append_log([bytes.fromhex(x) for x in table["digest"].to_pylist()], _levels(n, span))
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "nodes": [b"".join(log)], "digest": [log[-1].hex()]})

    return build


def _extractor(span: int):
    """Of the leaves asked for, the siblings level by level: L or R and a digest, or A for a node that has none; then those of the segment's top."""

    def siblings(nodes: bytes, i: int, leaves: int, levels: int) -> Iterator[str]:
        for level in range(levels):
            mine = i >> level
            other = mine ^ 1
            if other < nodes_at(level, leaves):
                at = 32 * position(level, other, leaves)
                yield ("L" if mine & 1 else "R") + nodes[at : at + 32].hex()
            else:
                yield "A"

    def extract(key: tuple, asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.append_column("path", pa.array([], pa.string())).append_column("subroot", pa.array([], pa.string())).append_column("root", pa.array([], pa.string()))
        (s,) = segment.to_pylist()
        first = s["block"] << span
        leaves, levels = min(s["n"] - first, 1 << span), _levels(s["n"], span)
        paths = ["".join(siblings(s["nodes"], i - first, leaves, levels)) + s["above"] for i in asked["idx"].to_pylist()]
        n = len(paths)
        return asked.append_column("path", pa.array(paths, pa.string())).append_column("subroot", pa.array([s["subroot"]] * n, pa.string())).append_column("root", pa.array([s["root"]] * n, pa.string()))

    return extract


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of fields, each `-` if null, else its bytes' count, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def tree_name(lang: Column) -> Column:
    """The tree of a language, in names that sort as the languages do, null before all."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with a column `tree`) with `idx`, the place within the tree from 0, and `n`, the tree's rows. Equal rows are dealt over partitions, too."""
    keys = ["tree", *order, "salt_"]
    placed = rows.withColumn("salt_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.drop("salt_").withColumn("at_", F.monotonically_increasing_id()), "placed").withColumn("part_", F.shiftright("at_", 33))
    run = Window.partitionBy("tree")
    counts = placed.groupBy("tree", "part_").agg(F.count(F.lit(1)).alias("own_"), F.min("at_").alias("first_"))
    counts = counts.withColumn("n", F.sum("own_").over(run)).withColumn("before_", F.sum("own_").over(run.orderBy("part_")) - F.col("own_")).drop("own_")
    return placed.join(counts, ["tree", "part_"]).withColumn("idx", F.col("before_") + F.col("at_") - F.col("first_")).drop("at_", "part_", "first_", "before_")


def build(leaves: DataFrame, span: int = SPAN) -> list[DataFrame]:
    """Segments of the logs of all trees, a table a round, from rows (tree, idx, n, digest). A segment's `digest` is its top's."""
    most, rows, rounds = leaves.agg(F.max("n")).first()[0] or 0, leaves.select("tree", "idx", "n", "digest"), []
    while most:
        groups = rows.groupBy("tree", F.shiftright("idx", span).alias("block"))
        rounds.append(written(groups.applyInArrow(_builder(span), SEGMENT), "segments"))
        rows = rounds[-1].filter(F.col("n") > 1 << span).select("tree", F.col("block").alias("idx"), F.shiftright(F.col("n") + (1 << span) - 1, span).alias("n"), "digest")
        most = nodes_at(span, most) if most > 1 << span else 0
    return rounds


def subroots(rounds: list[DataFrame], span: int = SPAN) -> DataFrame:
    """(tree, digest) of each tree's top."""
    return reduce(DataFrame.unionByName, (r.filter(F.col("n") <= 1 << span).select("tree", "digest") for r in rounds))


def prove(asked: DataFrame, rounds: list[DataFrame], tops: DataFrame, span: int = SPAN) -> DataFrame:
    """asked (tree, idx and what else it has) with `path`, `subroot` and `root`. tops: of each tree its subroot, the root, and the path from one to the other as `above`."""
    whole, above = F.col("n") <= 1 << span, None
    for k in reversed(range(len(rounds))):
        segments = rounds[k].drop("digest")
        held = segments.filter(whole).join(tops, "tree")
        if above is not None:
            higher = rounds[k].filter(~whole).select("tree", F.col("block").alias("idx"))
            higher = _prove_round(higher, above, span).select("tree", F.col("idx").alias("block"), F.col("path").alias("above"), "subroot", "root")
            held = held.unionByName(segments.filter(~whole).join(higher, ["tree", "block"]))
        above = held
    return _prove_round(asked, above, span)


def _prove_round(asked: DataFrame, segments: DataFrame, span: int) -> DataFrame:
    block = F.shiftright("idx", span).alias("block")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.groupBy("tree", block).cogroup(segments.groupBy("tree", "block")).applyInArrow(_extractor(span), f"{fields}, path string, subroot string, root string")


def siblings_digest(path: Column) -> Column:
    """Of the siblings on a path, in order, as one hash."""
    return F.sha2(F.translate(path, "LRA", ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to. This needs no log, so whoever holds a row and its path can check it."""
    join = lambda node, s: F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), node)).otherwise(F.concat(node, F.substring(s, 2, 64)))
    return F.aggregate(F.regexp_extract_all(path, F.lit("[LR][0-9a-f]{64}|A"), F.lit(0)), leaf, lambda node, s: F.sha2(join(node, s), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, lang: str = "lang", span: int = SPAN, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Of each row: id, leaf, subroot, root, path, the leaf of the row as it is now, and whether that and the path lead to the root.

    The first field is the id. tampered: columns that stand for fields in the row "as it is now", by name; by default none, so all rows are verified."""
    changed = [(tampered or {}).get(f, F.col(f)) for f in fields]
    leaf = leaf_digest(*map(F.col, fields))
    now = F.when(reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f)) for c, f in zip(changed, fields))), leaf).otherwise(leaf_digest(*changed)) if tampered else leaf
    leaves = written(docs.select(tree_name(F.col(lang)).alias("tree"), F.col(fields[0]).alias("id"), leaf.alias("digest"), now.alias("now")), "leaves")
    leaves = numbered(leaves, "id", "digest")
    rounds = build(leaves, span)
    if not rounds:
        return leaves.select("id", F.col("digest").alias("leaf"), *(F.lit("").alias(c) for c in ("subroot", "root", "path")), "now", F.lit("").alias("folded_root"), F.lit(True).alias("verified"))
    trees = subroots(rounds, span)
    top = numbered(trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    top_rounds = build(top, span)
    root = subroots(top_rounds, span).select("tree", F.lit("").alias("above"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = prove(top.select("tree", "idx", "name", "digest"), top_rounds, root, span).select(F.col("name").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    out = prove(leaves.select("tree", "idx", "id", F.col("digest").alias("leaf"), "now"), rounds, tops, span)
    out = out.withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return out.select("id", "leaf", "subroot", "root", "path", "now", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def log_rows(rounds: list[DataFrame], span: int = SPAN) -> DataFrame:
    """The whole log as rows (tree, position, digest): segments of all rounds, their nodes at their places in the tree."""

    def unfold(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch.to_pylist():
                    first = s["block"] << span
                    n = min(s["n"] - first, 1 << span)
                    places, hashes = [], []
                    # leaves of later rounds are nodes of earlier ones, which have written them
                    for level in range(min(k, 1), _levels(s["n"], span) + 1):
                        for i in range(nodes_at(level, n)):
                            places.append(position(k * span + level, (first >> level) + i, s["leaves"]))
                            at = 32 * position(level, i, n)
                            hashes.append(s["nodes"][at : at + 32].hex())
                    yield pa.RecordBatch.from_arrays([pa.array([s["tree"]] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(hashes, pa.string())], ["tree", "position", "digest"])

        return run

    total = rounds[0].select("tree", F.col("n").alias("leaves")).distinct()
    return reduce(DataFrame.unionByName, (r.join(total, "tree").mapInArrow(unfold(k), "tree string, position long, digest string") for k, r in enumerate(rounds)))
