"""Substring dedup: repeated-phrase automata.

A window of 35 words that occurs twice anywhere is a recurring phrase; every word under one is removed. Phrases are
found in three steps, none of which holds more than a bounded group in memory:

1. Screen. Of the 8-word grams in a window, the one with the smallest hash is its anchor, so equal windows have equal
   anchors, and about one word in 15 starts an anchor. Anchors are counted over the whole corpus; a window whose anchor
   occurs once can't recur.
2. Confirm. The stretch of words around each recurring anchor goes to the shard of that anchor, where its windows are
   counted word by word. An anchor with very many stretches is dealt over several shards; windows that one of these
   sees once are then compared over all of them by digest.
3. Locate. Each shard compiles an Aho-Corasick automaton of its confirmed phrases, over words as symbols, and streams
   all of its stretches through it. The matches, given as word spans, go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import row_key, small_batches, written

WINDOW = 35
GRAM = 8
#: Stretches of one anchor in one shard at most; a commoner anchor is dealt over several.
GROUP_LIMIT = 4096
#: Stretches after which a shard's automaton is compiled and the next one begun.
SHARD_ROWS = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(text: bytes, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Of words that single spaces part; equal words have equal hashes wherever they are."""
    raw = np.frombuffer(text, np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    start, stop = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(raw)]))
    return _mix((sums[stop] - sums[start]) * inverse[start])


def _first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` values, the place of its first smallest one."""
    places, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = values[step:] < values[:-step]
        places = np.where(later, places[step:], places[:-step])
        values = np.where(later, values[step:], values[:-step])
        span += step
    return places


def _anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor in the texts: the text's place in the list, the anchor's hash, the windows that it stands for (the first one's first word, and how many), and how often it occurs in a row. Where a text repeats itself an anchor follows itself; these occurrences make one stretch."""
    texts = [b" ".join((x or b"").split()) for x in texts]
    words = np.array([x.count(b" ") + 1 if x else 0 for x in texts], np.int64)
    flat, n = b" ".join(x for x in texts if x), int(words.sum())
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    if len(flat) > len(_anchors.powers[0]):
        _anchors.powers = tuple(_powers(b, max(1 << 21, 2 * len(flat))) for b in (_BASE, _INVERSE))
    with np.errstate(over="ignore"):
        hashes = _word_hashes(flat, *_anchors.powers)
        grams, factor = np.zeros(n - gram + 1, np.uint64), np.uint64(1)
        for j in range(gram):
            grams += hashes[j : n - gram + 1 + j] * factor
            factor = factor * _BASE
        grams = _mix(grams)
    owner = _first_minimum(grams, window - gram + 1)
    text = np.repeat(np.arange(len(texts)), words)
    starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    owner = owner[starts]
    if not len(owner):
        return _anchors([], window, gram)
    changes = owner[1:] != owner[:-1]
    leaps = changes & ((grams[owner[1:]] != grams[owner[:-1]]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(np.concatenate(([True], leaps)))
    many = np.diff(np.append(first, len(owner)))
    times = np.add.reduceat(np.concatenate(([1], changes)), first)
    at = starts[first]
    begins = np.cumsum(words) - words
    return text[at], grams[owner[first]].view(np.int64), (at - begins[text[at]]).astype(np.int32), many.astype(np.int32), times.astype(np.int32)


_anchors.powers = (np.zeros(0, np.uint64),) * 2


def _emit_hashes(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "body"):
            _, hashes, _, _, times = _anchors(batch.column("body").to_pylist(), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(times)], ["anchor", "times"])

    return run


def _emit_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "body"):
            text, hashes, first, many, _ = _anchors(batch.column("body").to_pylist(), window, gram)
            keys = [batch.column(k).take(pa.array(text)) for k in ("k_id", "k_text")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(hashes), pa.array(first), pa.array(many)], ["k_id", "k_text", "anchor", "first", "many"])

    return run


def _emit_stretches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (body, anchors) in enumerate(zip(batch.column("body"), batch.column("anchors"), strict=True)):
                words = body.as_py().split()
                rows = anchors.as_py()
                stretch = [b" ".join(words[a["first"] : a["first"] + a["many"] + window - 1]) for a in rows]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("k_id")[i].as_py()] * n, pa.int64()), pa.array([batch.column("k_text")[i].as_py()] * n, pa.int64()), pa.array([a["anchor"] for a in rows], pa.int64()), pa.array([a["shares"] for a in rows], pa.int32()), pa.array([a["first"] for a in rows], pa.int32()), pa.array([a["many"] for a in rows], pa.int32()), pa.array(stretch, pa.binary())],
                    ["k_id", "k_text", "anchor", "shares", "first", "many", "stretch"],
                )

    return run


def _cover(found: list[int], window: int) -> list[int]:
    """Of confirmed windows in a stretch, enough to cover all the words that they cover: both ends of each run, and every window-th between."""
    out: list[int] = []
    for k, i in enumerate(found):
        ends = k + 1 == len(found) or found[k + 1] != i + 1
        begins = k == 0 or found[k - 1] != i - 1
        if begins or ends or i - out[-1] == window:
            out.append(i)
    return out


def _locate_in_shard(rows: list[tuple], window: int) -> list[tuple]:
    """rows: (id, text hash, first word, windows, stretch, shards of its anchor). Returns (id, text hash, begin, finish, None) for each match, and for anchors of several shards windows with their digest: those seen once with their place, of the others one without."""
    import ahocorasick

    symbols: dict[bytes, str] = {}

    def symbol(word: bytes) -> str:
        n = len(symbols) + 256
        return symbols.setdefault(word, chr(n if n < 0xD800 else n + 0x800))

    known = symbols.get
    streams = ["".join([known(w) or symbol(w) for w in r[4].split(b" ")]) for r in rows]
    counts: dict[str, int] = {}
    for r, s in zip(rows, streams, strict=True):
        for i in range(r[3]):
            phrase = s[i : i + window]
            counts[phrase] = counts.get(phrase, 0) + 1
    phrases, out, told = ahocorasick.Automaton(), [], set()
    for r, s in zip(rows, streams, strict=True):
        found = [i for i in range(r[3]) if counts[s[i : i + window]] > 1]
        for i in _cover(found, window):
            phrases.add_word(s[i : i + window], True)
        if r[5] > 1:
            words = r[4].split(b" ")
            for i in range(r[3]):
                phrase = s[i : i + window]
                if phrase not in told:
                    told.add(phrase)
                    place = (r[0], r[1], r[2] + i, r[2] + i + window) if counts[phrase] == 1 else (None,) * 4
                    out.append((*place, hashlib.md5(b" ".join(words[i : i + window]), usedforsecurity=False).digest()))
    if not len(phrases):
        return out
    phrases.make_automaton()
    for r, s in zip(rows, streams, strict=True):
        begin = end = -1
        for last, _ in phrases.iter(s):
            if last - window + 1 > end:
                if end >= 0:
                    out.append((r[0], r[1], r[2] + begin, r[2] + end, None))
                begin = last - window + 1
            end = last + 1
        if end >= 0:
            out.append((r[0], r[1], r[2] + begin, r[2] + end, None))
    return out


def _locate(window: int, shard_rows: int):
    types = {"k_id": pa.int64(), "k_text": pa.int64(), "begin": pa.int32(), "finish": pa.int32(), "digest": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_locate_in_shard(rows, window), strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "salt", "k_id", "k_text", "first", "many", "stretch", "shares")]
            for anchor, salt, *row in zip(*columns, strict=True):
                if len(rows) >= shard_rows and (anchor, salt) != group:
                    yield flush()
                    rows = []
                group = (anchor, salt)
                rows.append(tuple(row))
        if rows:
            yield flush()

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_limit: int = GROUP_LIMIT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Where passages of `window` words that recur in the corpus lie.

    Returns k_id, k_text (see row_key) and spans, an array of (begin, finish) word offsets, overlapping ones not
    merged, for each document with any. Null and short texts have none. Copies of a row count as recurrences of each
    other. An empty table gives an empty result."""
    id_, body = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*row_key(id_, body), body.cast("binary").alias("body"))
    counts = texts.select("body").mapInArrow(_emit_hashes(window, gram), "anchor long, times int").groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1")
    anchors = texts.mapInArrow(_emit_anchors(window, gram), "k_id long, k_text long, anchor long, first int, many int")
    # The number of shards that an anchor's stretches are dealt over; 1 for nearly all.
    shares = F.ceil(F.col("n") / group_limit).cast("int").alias("shares")
    recurring = anchors.join(counts.select("anchor", shares), "anchor")
    # Bounded by the length of one document; copies of a row have the same anchors, once each.
    per_text = recurring.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("first", "many", "anchor", "shares")).alias("anchors"))
    joined = texts.join(per_text, ["k_id", "k_text"])
    stretches = joined.mapInArrow(_emit_stretches(window), "k_id long, k_text long, anchor long, shares int, first int, many int, stretch binary")
    salt = F.pmod(F.xxhash64("k_id", "k_text", "first"), F.col("shares")).cast("int").alias("salt")
    shards = stretches.withColumn("salt", salt).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = written(shards.mapInArrow(_locate(window, shard_rows), "k_id long, k_text long, begin int, finish int, digest binary"), "phrases")
    once = found.where("digest is not null")
    over_shards = once.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    spans = found.where("digest is null").drop("digest").union(once.where("k_id is not null").join(over_shards, "digest").drop("digest"))
    return spans.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, removed = [], [], []
        for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, done, parts = body.split(), 0, []
            for begin, finish in sorted((s["begin"], s["finish"]) for s in spans or ()):
                parts += words[done:begin]
                done = max(done, finish)
            parts += words[done:]
            kept.append(b" ".join(parts))
            total.append(len(words))
            removed.append(len(words) - len(parts))
        yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("null_id"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["k_id", "null_id", "kept", "n_words", "n_removed"])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: its id (bigint), kept_text (the words outside recurring passages, joined by single spaces), n_words and n_removed.

    A null text is an empty one. Parameters as for repeated_spans."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col(id_col), body), F.col(id_col).isNull().alias("null_id"), body.cast("binary").alias("body"))
    joined = texts.join(repeated_spans(docs, id_col, text_col, **how), ["k_id", "k_text"], "left").select("k_id", "null_id", "body", "spans")
    out = joined.mapInArrow(_cut, "k_id long, null_id boolean, kept binary, n_words long, n_removed long")
    return out.select(F.when(~F.col("null_id"), F.col("k_id")).alias(id_col), F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed")
