"""Exact dedup: static binary-fuse filters per immutable snapshot.

The table arrives in batches. Each batch is grouped by digest on its own and then becomes an immutable snapshot, for
which filters are built once: one for each shard of its digests, of a bounded number of keys, kept as a table. The
digests of a later batch are screened by the filters of all earlier ones; only those that pass are joined with the
snapshot's exact buckets, and only rows whose digest is then known to occur twice have their bytes compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import fresh, row_key, written

BATCHES = 3
#: Keys in one filter, about 1.2 bytes each.
SHARD_KEYS = 1_000_000


class BinaryFuse:
    """A binary-fuse filter with three slots a key and 8-bit fingerprints: no false negatives, about one false positive in 256.

    Keys are distinct unsigned 64-bit numbers. All keys that are alone in a slot are peeled off at once, so that each
    round is a few array operations."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = keys + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(33)
        first = ((h >> np.uint64(40)) * np.uint64(self.segments) >> np.uint64(24)).astype(np.int64)
        within = [((h >> np.uint64(s)) & np.uint64(self.segment - 1)).astype(np.int64) for s in (0, 11, 22)]
        return np.stack([(first + i) * self.segment + w for i, w in enumerate(within)], 1), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 11))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        for seed in range(1, 200):
            segments = max(1, int(np.ceil(n * factor * (1 + 0.01 * (seed - 1)) / segment)) - 2)
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            places, marks = out._places(keys)
            count = np.bincount(places.ravel(), minlength=len(out.slots))
            held = np.zeros(len(out.slots), np.int64)  # exclusive or of the keys (as places in the array) in each slot
            for k in range(3):
                np.bitwise_xor.at(held, places[:, k], np.arange(n))
            rounds, left = [], n
            while left:
                alone = np.flatnonzero(count == 1)
                if not len(alone):
                    break
                peeled, at = np.unique(held[alone], return_index=True)
                rounds.append((peeled, alone[at]))
                for k in range(3):
                    np.subtract.at(count, places[peeled, k], 1)
                    np.bitwise_xor.at(held, places[peeled, k], peeled)
                left -= len(peeled)
            if not left:
                for peeled, slot in reversed(rounds):
                    others = out.slots[places[peeled]]
                    out.slots[slot] = marks[peeled] ^ others[:, 0] ^ others[:, 1] ^ others[:, 2] ^ out.slots[slot]
                return out
        raise ValueError("the keys are not distinct")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        places, marks = self._places(keys)
        found = self.slots[places]
        return (found[:, 0] ^ found[:, 1] ^ found[:, 2]) == marks


def _key64(digests: pa.Array) -> np.ndarray:
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, 32)[:, 8:16].copy().view("<u8").ravel()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in batch.column("body")]
        names = [c for c in batch.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], [*names, "digest"])


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [(x.as_py() or b"").lower() for x in batch.column("body")]
        made = [hashlib.sha256(x).digest() for x in plain]
        yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), pa.array(plain, pa.binary()), pa.array(made, pa.binary())], ["k_id", "k_text", "plain", "digest"])


def _build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by snapshot and shard to one filter each."""
    keys: list[np.ndarray] = []
    group = None

    def flush() -> pa.RecordBatch:
        f = BinaryFuse.build(np.unique(np.concatenate(keys)))
        return pa.RecordBatch.from_pydict({"batch": pa.array([group[0]], pa.int32()), "shard": pa.array([group[1]], pa.int32()), "seed": pa.array([f.seed], pa.int32()), "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()), "slots": pa.array([f.slots.tobytes()], pa.binary())})

    for batch in batches:
        made, shard = batch.column("batch").to_numpy(), batch.column("shard").to_numpy()
        hashes = _key64(batch.column("digest"))
        edges = np.flatnonzero((made[1:] != made[:-1]) | (shard[1:] != shard[:-1])) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(made)), strict=True):
            if a == b:
                continue
            if group != (now := (made[a], shard[a])):
                if group:
                    yield flush()
                group, keys = now, []
            keys.append(hashes[a:b])
    if group:
        yield flush()


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its filters first: digests that a filter of an earlier batch lets pass, with that batch."""
    filters: dict[int, BinaryFuse] = {}
    shard_now = None
    for batch in batches:
        shards, slots = batch.column("shard").to_numpy(), batch.column("slots")
        made = batch.column("batch").to_numpy()
        is_filter = np.array(slots.is_valid())
        edges = np.flatnonzero((shards[1:] != shards[:-1]) | (is_filter[1:] != is_filter[:-1])) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(shards)), strict=True):
            if a == b:
                continue
            if shards[a] != shard_now:
                shard_now, filters = shards[a], {}
            if is_filter[a]:
                for i in range(a, b):
                    x = {c: batch.column(c)[i].as_py() for c in ("batch", "seed", "segment", "segments", "slots")}
                    filters[x["batch"]] = BinaryFuse(x["seed"], x["segment"], x["segments"], np.frombuffer(x["slots"], np.uint8))
                continue
            part = batch.slice(a, b - a)
            keys = _key64(part.column("digest"))
            for snapshot, f in filters.items():
                hit = np.flatnonzero((made[a:b] > snapshot) & f.may_hold(keys))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(hit)), pa.array([snapshot] * len(hit), pa.int32())], ["digest", "snapshot"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: Column | None = None, batches: int = BATCHES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of docs: k_id, k_text (see row_key), null_id, digest (binary SHA-256 of the text with A-Z lower-cased), keep (k_id of the row that stays, the largest of its group), group_size and kept.

    batch: the number, from 0, of the batch in which a row arrives; by default a hash of the id deals rows into
    `batches`. The result is the same however rows are dealt. A null text is an empty one, a null id the smallest; of
    rows that tie on the largest id one is kept. An empty table gives an empty one."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col)
    arrival = batch if batch is not None else F.pmod(F.xxhash64(id_), F.lit(batches))
    texts = docs.select(*row_key(id_, body), id_.isNull().alias("null_id"), arrival.cast("int").alias("batch"), body.cast("binary").alias("body"))
    rows = written(texts.mapInArrow(_digests, "k_id long, k_text long, null_id boolean, batch int, digest binary"), "digests")

    shards = max(1, -(-rows.count() // shard_keys))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    buckets = rows.groupBy("batch", "digest").agg(F.count("*").alias("n"))  # new-batch duplicates
    keyed = buckets.select("batch", shard, "digest")
    filters = written(keyed.repartition("batch", "shard").sortWithinPartitions("batch", "shard").mapInArrow(_build_filters, "batch int, shard int, seed int, segment int, segments int, slots binary"), "filters")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("seed", "int"), ("segment", "int"), ("segments", "int"), ("slots", "binary"))]
    probes = filters.select("shard", F.lit(0).alias("kind"), "batch", F.lit(None).cast("binary").alias("digest"), "seed", "segment", "segments", "slots").unionByName(keyed.select("shard", F.lit(1).alias("kind"), "batch", "digest", *empty))
    passed = probes.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_screen, "digest binary, snapshot int")
    in_buckets = passed.join(buckets.select(F.col("batch").alias("snapshot"), "digest"), ["snapshot", "digest"]).select("digest")
    twice = buckets.where("n > 1").select("digest").union(in_buckets).distinct()

    # Bytes: only of rows whose digest occurs twice. Equal texts fold before the shuffle.
    suspects = texts.select("k_id", "k_text", "body").mapInArrow(_with_bytes, "k_id long, k_text long, plain binary, digest binary").join(twice, "digest")
    groups = suspects.groupBy("digest", "plain").agg(F.max("k_id").alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    members = suspects.join(groups, ["digest", "plain"]).select("k_id", "k_text", "keep", "group_size").distinct()
    out = rows.join(members, ["k_id", "k_text"], "left")
    turn = F.row_number().over(Window.partitionBy("digest", "k_id").orderBy("k_text"))
    keep = F.coalesce("keep", "k_id")
    return out.select("k_id", "k_text", "null_id", "digest", keep.alias("keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"), ((keep == F.col("k_id")) & (turn == 1)).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k_id, k_text = row_key(F.col(id_col), body)
    rows = exact_groups(docs, id_col, text_col, **how).where("group_size > 1")
    # A key that stays once while copies of the same row go is marked; its rows can't be told apart, so one of them is taken.
    marks = rows.groupBy("k_id", "k_text").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1").select("k_id", "k_text", "stays")
    joined = docs.join(marks, (k_id == marks.k_id) & (k_text == marks.k_text), "left").drop(marks.k_id, marks.k_text)
    alone = joined.where("stays is null").drop("stays")
    # By their keys, so that a null and an empty text of one id are copies, too.
    names = fresh(docs, "id_key", "text_key")
    repeated = joined.where("stays").drop("stays").withColumns(dict(zip(names, (k_id, k_text))))
    return alone.unionByName(repeated.dropDuplicates(names).drop(*names))
