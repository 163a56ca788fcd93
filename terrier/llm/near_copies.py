"""Near-dedup by SimHash balls over five-word shingles, verified by exact Jaccard similarity, with min-hash bands for what lies outside a ball.

Texts with the same set of shingles are one node. A node has the SimHash fingerprint of its set; fingerprints that operator 8's
ball hashing links (at most 2 bits apart) make the first pairs, and those whose sets are similar enough are connected. Five-word
sets of similarity 0.8 mostly lie some ten bits apart, so bands bring the rest: a node has BANDS keys, each of BAND_ROWS minima of its shingles under
random permutations; nodes that agree in a key share a bucket. A pair of similarity s shares none with probability
(1 - s ** BAND_ROWS) ** BANDS, which is 7e-5 at 0.8 and less above. Every pair of a bucket whose nodes are not connected
yet is compared in rounds: by a bound on the similarity that small bitmaps of the sets give, by the same from large ones, and by
the whole sets unless a bound rules the pair out already: first with the bucket's least node, then with eight times as many each
round until all have had their turn. A group of near copies is connected in the first rounds and costs no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import drop_written, row_key, written
from terrier.llm.simhash import link_prints, majority
from terrier.operators.components import connected_components

SHINGLE, SIMILAR = 5, 0.8
BANDS, BAND_ROWS = 24, 5
SEED = 42
#: Words of 64 bits in the bitmap of a set that goes with its keys, and in the one that is fetched before the set itself.
BITMAP, WIDE = 8, 64
#: By how much the nodes of a bucket that others are compared with grow from round to round.
GROWTH = 8


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text's words, A-Z lower-cased, in order; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    join = b" ".join
    return np.unique(np.array([xxh64_intdigest(join(s), SEED) for s in shingles], np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band (bigint); texts without shingles have none."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    draws = np.random.default_rng(SEED).integers(0, 2**63, (2, bands * rows), dtype=np.uint64)
    factor, offset = draws[0] * np.uint64(2) + np.uint64(1), draws[1]
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            least = np.minimum(least, (hashes[i : i + 512, None] * factor + offset).min(axis=0))
    return np.array([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.astype("<u8").reshape(bands, rows))], np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray, size: int = BITMAP) -> list[int]:
    """One bit for each group of hashes (by their first bits) of which the set has any, as `size` signed words."""
    words = np.zeros(size, np.uint64)
    group = hashes >> np.uint64(64 - int(np.log2(size * 64)))
    np.bitwise_or.at(words, (group >> np.uint64(6)).astype(np.int64), np.uint64(1) << (group & np.uint64(63)))
    return words.view(np.int64).tolist()


def _at_most(size: Column, words: list[Column], other_size: Column, other_words: list[Column]) -> Column:
    """An upper bound on the similarity of two sets: for each group that only one of them has, one of its members at least is not in the other."""
    alone = lambda xs, ys: sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(xs, ys, strict=True)), F.lit(0))
    both = F.least(size - alone(words, other_words), other_size - alone(other_words, words))
    return both / (size + other_size - both)


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)).view(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py() or b"") for x in batch.column("body")]
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), prints, keys, pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], ["k_id", "k_text", "node", "size", "print", "keys", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py() or b"").view(np.int64) for x in batch.column("body")]
        wide = [bitmap(x.view(np.uint64), WIDE) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array(wide, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "wide", "shingles"])


def ball_pairs(prints: DataFrame) -> DataFrame:
    """prints (node, print): pairs (a, b) of nodes to verify, one or two a node and ball: each node with the least one of its fingerprint, and the least ones of fingerprints that ball hashing links."""
    heads = prints.groupBy("print").agg(F.min("node").alias("head"))
    same = prints.join(heads, "print").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ends = heads.select(F.col("print").alias("least"), F.col("head").alias("other"))
    across = link_prints(heads.select("print")).join(heads, "print").join(ends, "least").select(F.least("head", "other").alias("a"), F.greatest("head", "other").alias("b"))
    return same.unionByName(across).distinct()


def _may_be_similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of pairs (a, b) that the bound from large bitmaps doesn't rule out. A bitmap is a few hundred bytes where a set may have many thousand, so most pairs go without their sets being sent for."""
    a, b = (sets.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("wide").alias(f"{n}_wide")) for n in ("a", "b"))
    met = pairs.join(a, "a").join(b, "b")
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    both = F.least(F.col("a_size") - alone("a_wide", "b_wide"), F.col("b_size") - alone("b_wide", "a_wide"))
    return met.where(both / (F.col("a_size") + F.col("b_size") - both) >= similar - 1e-9).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of pairs (a, b) whose sets are at least so similar."""
    pairs = _may_be_similar(pairs, sets, similar)
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(both / (F.size("x") + F.size("y") - both) >= similar).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: k_id, k_text (see row_key), node (a hash of its set of shingles), root (struct of the smallest k_id and k_text in its component).

    Components are those of the links between texts whose shingles have a Jaccard similarity of at least `similar`.
    Null and empty texts have the same, empty set, and no link to others; a null id counts as the smallest. An empty
    table gives an empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col(id_col), body), body.cast("binary").alias("body"))
    rows = written(texts.mapInArrow(_signed, "k_id long, k_text long, node long, size int, print long, keys array<long>, bits array<long>"), "signed")
    nodes = rows.groupBy("node").agg(F.min(F.struct("k_id", "k_text")).alias("root"))

    each = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits")).select("node", "size", *[F.col("bits")[i].alias(f"w{i}") for i in range(BITMAP)], F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node"))
    met = written(each.join(shared, "key").withColumn("turn", turn), "met")
    balls = written(ball_pairs(rows.where("size > 0").groupBy("node").agg(F.first("print").alias("print"))), "balls")
    asked = met.select("node").union(balls.select("a")).union(balls.select("b")).distinct()
    firsts = nodes.join(asked, "node", "left_semi").select("node", "root.k_id", "root.k_text")
    sets = written(texts.join(firsts, ["k_id", "k_text"]).select("node", "body").dropDuplicates(["node"]).mapInArrow(_sets, "node long, size int, wide array<long>, shingles array<long>"), "sets")

    links = written(_similar(balls, sets, similar), "similar")
    labels, done, most = written(connected_components(links, "a", "b"), "labels"), 0, met.agg(F.max("turn")).first()[0] or 0
    while done < most - 1:
        upto = done * GROWTH or 1
        named = met.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # What is in one component already is not compared, so a bucket in one piece drops out.
        # Written, as all that follows reads it: its plan would else stand in the driver's memory several times over.
        open_ = written(named.join(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"), "key"), "open")
        if open_.isEmpty():
            drop_written(docs.sparkSession, open_)
            break
        leaders = open_.where((F.col("turn") > done) & (F.col("turn") <= upto)).select("key", F.col("node").alias("leader"), F.col("size").alias("leader_size"), F.col("turn").alias("leader_turn"), F.col("component").alias("of"), *[F.col(f"w{i}").alias(f"leader_w{i}") for i in range(BITMAP)])
        words, others = ([F.col(f"{side}w{i}") for i in range(BITMAP)] for side in ("", "leader_"))
        fit = _at_most(F.col("size"), words, F.col("leader_size"), others) >= similar - 1e-9
        across = open_.join(leaders, "key").where((F.col("turn") > F.col("leader_turn")) & (F.col("component") != F.col("of")) & fit)
        pairs = across.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        links = links.unionByName(written(_similar(pairs, sets, similar), "similar"))
        old, labels = labels, written(connected_components(links, "a", "b"), "labels")
        drop_written(docs.sparkSession, old)
        drop_written(docs.sparkSession, open_)
        done = upto
    labelled = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = labelled.groupBy("component").agg(F.min("root").alias("root"))
    of_node = labelled.select("node", "component").join(roots, "component").select("node", "root")
    return rows.join(of_node, "node").select("k_id", "k_text", "node", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that are near copies of another: of each component the row with the smallest id stays. Rows that agree in id and text are one document and stay together."""
    gone = near_copies(docs, id_col, text_col, **how).where("k_id != root.k_id or k_text != root.k_text").select("k_id", "k_text").distinct()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k_id, k_text = row_key(F.col(id_col), body)
    return docs.join(gone, (k_id == gone.k_id) & (k_text == gone.k_text), "left_anti")
