"""Ranked lexical search by the Best Position Algorithm.

Documents are counted once: for the terms that the items ask for, each text's counts, kept with its length. Corpus counts
(documents, terms, documents a term) are sums over that table. Then every task takes its share of documents, in chunks of
bounded size, and forms an impact list for each term: its documents, best first. For one item, the lists' next unseen
positions are read directly; each new document is looked up in all lists of the item (its counts name the terms it holds
and its places in their lists), which marks those places as seen, too. The best position of a list is the end of its
unbroken run of seen places, wherever sorted reading stands; no unseen document can score more than the sum of what comes
right behind the best positions. A chunk is done as soon as that is strictly below the k-th score found, so that
documents of equal score and smaller id are not missed; the k best go on to the task's next chunk, and at last those of
all tasks meet, at most k an item and task.

Rows that share an item id are one item with the terms of all; equal rows of documents are documents of their own and rank
side by side. A null id is an id (of an item) or sorts last among equal scores (of a document). Texts that are null or
hold no term count for nothing, an item without terms or without matches has no rows, and empty tables give none. Other
columns are not read. Items are taken in blocks of about PAIRS item-term pairs, one pass over the counts each.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrier.llm.common import ascii_lower, small_batches, written

TOP = 50
#: Fixed values of the measure: the weight's scale; a term's score is SCALE * tf over UNIT * tf + FLAT * length norm.
WEIGHT, SCALE, UNIT, FLAT, FULL, SLOPE = 1000, 1_000_000_000, 1000, 20, 100, 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item-term pairs of a block, which go to every task. A longer term is named by its digest, so a block has bounded bytes.
PAIRS, LONGEST = 1 << 17, 64
#: Postings of a chunk, documents of a lookup's slice (in postings), and places of a list read at once: first and at most.
CHUNK, SLICE, FIRST, MOST = 1 << 21, 1 << 19, 32, 1024

_CUT = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Stands for a null id, after all others.
_LAST = 1 << 63


def terms(text: Column) -> Column:
    """Distinct terms of a text; those of over LONGEST bytes as a blank and a digest, which no term can be."""
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))
    return F.transform(found, lambda t: F.when(F.octet_length(t) <= LONGEST, t).otherwise(F.concat(F.lit(" "), F.sha2(t, 256))))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms(F.col(text_col))).alias("term")).distinct()


def _counter(wanted: dict[bytes, int]):
    """Of each text: how many terms, and the numbers and counts of those that are wanted."""
    from hashlib import sha256

    long = any(t.startswith(b" ") for t in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 22):
            sizes, numbers, counts = [], [], []
            for text in batch.column("text"):
                found = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_CUT).split()
                held = Counter(found)
                if long:
                    held = {b" " + sha256(t).hexdigest().encode() if len(t) > LONGEST else t: n for t, n in held.items()}
                mine = [(k, n) for t, n in held.items() if (k := wanted.get(t)) is not None]
                sizes.append(len(found))
                numbers.append([k for k, _ in mine])
                counts.append([n for _, n in mine])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "numbers", "counts"])

    return run


class Lists:
    """The impact lists of a chunk of documents: postings by document, each with its place in its term's list, and the lists' documents, best first."""

    def __init__(self, ids: list[int], sizes: np.ndarray, begins: np.ndarray, numbers: np.ndarray, counts: np.ndarray, docs: int, total: int, n_terms: int):
        self.ids, self.begins, self.numbers = np.array(ids, object), begins, numbers
        norm = FULL - SLOPE + (SLOPE * sizes * docs) // total
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(begins))
        self.impacts = (SCALE * counts) // (UNIT * counts + FLAT * norm[doc])
        order = np.lexsort((-self.impacts, numbers))
        self.firsts = np.searchsorted(numbers[order], np.arange(n_terms + 1))
        self.docs, self.sorted = doc[order], self.impacts[order]
        self.places = np.empty(len(order), np.int64)
        self.places[order] = np.arange(len(order)) - self.firsts[numbers[order]]

    def postings(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The postings of documents, in slices: the documents, their postings, and where each document's begin."""
        lengths = self.begins[docs + 1] - self.begins[docs]
        ends = np.cumsum(lengths)
        first = 0
        while first < len(docs):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            n, starts = lengths[first:last], ends[first:last] - lengths[first:last] - base
            yield docs[first:last], np.repeat(self.begins[docs[first:last]] - starts, n) + np.arange(n.sum()), starts
            first = last


def best_positions(lists: Lists, wanted: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int, slots: np.ndarray) -> int:
    """Adds one item's best documents of a chunk to `best`, a heap of (score, -id) of at most `top`. Returns how many documents were looked up.

    wanted: the item's terms, weights: all terms' weights, slots: -1 for all terms, and so again at the end."""
    wanted = wanted[(lists.firsts[wanted + 1] > lists.firsts[wanted]) & (weights[wanted] > 0)]
    first, length = lists.firsts[wanted], lists.firsts[wanted + 1] - lists.firsts[wanted]
    offset = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    # A list's seen places, and behind them one that never is.
    slots[wanted] = np.arange(len(wanted))
    seen = np.zeros(offset[-1], bool)
    at, step, looked = np.zeros(len(wanted), np.int64), FIRST, 0
    weight = weights[wanted]
    while True:
        open_ = np.flatnonzero(at < length)
        bound = int((weight[open_] * lists.sorted[first[open_] + at[open_]]).sum())
        if not bound or (len(best) == top and bound < best[0][0]):
            break
        read = []
        for i in open_:
            end = min(at[i] + step, length[i])
            fresh = ~seen[offset[i] + at[i] : offset[i] + end]
            read.append(lists.docs[first[i] + at[i] : first[i] + end][fresh])
        docs = np.unique(np.concatenate(read))
        looked += len(docs)
        for some, posting, starts in lists.postings(docs):
            slot = slots[lists.numbers[posting]]
            mine = slot >= 0
            gain = np.where(mine, weights[lists.numbers[posting]] * lists.impacts[posting], 0)
            score = np.add.reduceat(gain, starts)
            seen[offset[slot[mine]] + lists.places[posting[mine]]] = True
            if len(best) == top:
                some, score = some[score >= best[0][0]], score[score >= best[0][0]]
            for s, d in zip(score.tolist(), lists.ids[some]):
                if s > 0:
                    (heapq.heappush if len(best) < top else heapq.heappushpop)(best, (s, -d))
        for i in open_:
            run = seen[offset[i] + at[i] : offset[i + 1]]
            at[i] += len(run) if run.all() else int(run.argmin())
        step = min(2 * step, MOST)
    slots[wanted] = -1
    return looked


def _search(items: list, wanted: list[np.ndarray], weights: np.ndarray, docs: int, total: int, top: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        slots = np.full(len(weights), -1, np.int32)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.cumsum(table["postings"].to_numpy())]).astype(np.int64)
            lists = Lists([_LAST if d is None else d for d in table["doc_id"].to_pylist()], table["n"].to_numpy(), begins, flat("numbers"), flat("counts").astype(np.int64), docs, total, len(weights))
            for mine, found in zip(wanted, best):
                best_positions(lists, mine, weights, found, top, slots)
            held.clear()

        size = 0
        for batch in batches:
            first, ends = 0, np.cumsum(batch.column("postings").to_numpy(zero_copy_only=False))
            while first < batch.num_rows:
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + chunk - size, "right")))
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1] - base)
                first = last
                if size >= chunk or first < batch.num_rows:
                    search()
                    size = 0
        if held:
            search()
        out = [(i, s, None if d == -_LAST else -d) for i, found in zip(items, best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["item_id", "score", "doc_id"])

    return run


def _search_block(docs: DataFrame, pairs: list, top: int, chunk: int) -> DataFrame | None:
    """The best of each item of one block, from its (item, term) pairs."""
    names = sorted({p.term for p in pairs})
    number = {t: k for k, t in enumerate(names)}
    counted = written(docs.mapInArrow(_counter({t.encode(): k for t, k in number.items()}), "doc_id long, n long, numbers array<int>, counts array<int>"), "counted")
    n_docs, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    held = counted.filter(F.size("numbers") > 0)
    df = {r.number: r.df for r in held.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df")).collect()}
    weight = [int(np.floor(WEIGHT * np.log((2.0 * n_docs + 2.0) / (2.0 * df[k] + 1.0)))) if k in df else 0 for k in range(len(names))]
    asked: dict = {}
    for p in pairs:
        asked.setdefault(p.item_id, []).append(number[p.term])
    run = _search(list(asked), [np.array(sorted(x), np.int64) for x in asked.values()], np.array(weight, np.int64), n_docs, total, top, chunk)
    return held.select("doc_id", "n", F.size("numbers").cast("long").alias("postings"), "numbers", "counts").mapInArrow(run, "item_id long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs: int = PAIRS, chunk: int = CHUNK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of highest score above 0, equal scores by ascending id."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = written(item_terms(items, item_col, item_text_col), "asked")
    blocks = -(-asked.count() // pairs)
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    found = [_search_block(texts, blocked.filter(F.col("block") == b).collect(), top, chunk) for b in range(blocks)]
    schema = "item_id long, score long, doc_id long"
    parts = reduce(DataFrame.unionByName, [f for f in found if f is not None], spark.createDataFrame([], schema))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
