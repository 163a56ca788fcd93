"""Approximate nearest neighbours by balanced posting lists.

Centroids come from cutting a bounded sample in halves again and again, so that lists are of like size. A vector goes to
its nearest centroid's list and, if it lies near a boundary, to those of the centroids beyond it. A query walks an
in-memory graph of the centroids, best first, and reads the lists whose distance is within a ratio of the nearest one's.
The ratio is fitted on the sample: of the near neighbours within it, all but a small share lie in lists within the ratio.
Lists are dealt to shards, which hold their vectors while queries stream past; a query visits a shard once, whatever
number of its lists it reads. Scores are inner products of the original vectors in double precision.

Equal vectors are indexed as one, with the smallest ids that bear it: among equals only those can be among the nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import written
from terrier.llm.mixing import unit_hash

K = 20
#: Distinct vectors that the centroids are fitted on at most, and those of them that the ratio is fitted on.
SAMPLE, TRIED = 20_000, 400
#: Distinct vectors to a centroid, about; centroids at most (so the graph's size is bounded, and each has some vectors of the sample).
LIST_SIZE, MAX_LISTS = 200, 4096
#: Entries of lists in a shard, about, but as many shards as this at least; entries of one list that go to one shard, at most about.
SHARD, LEAST_SHARDS, CHUNK = 65_536, 16, 8192
#: Lists that a vector may go to, and by what ratio their distance may exceed the nearest one's.
REPLICAS, BOUNDARY = 4, 1.01
#: Share of the sample's near neighbours that the lists within the ratio hold, and the least ratio.
TARGET, LEAST_RATIO = 0.95, 1.02
#: Links of a centroid in the graph, without those from the other side; centroids that a walk expands at least, and by what ratio it goes on beyond what is read.
NEIGHBOURS, BEAM, BEYOND = 24, 48, 1.03


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Centroids:
    """Centroids in a space with one more component, in which the nearest by distance has the largest inner product, and the graph over them."""

    def __init__(self, points: np.ndarray, norm: float, ratio: float = LEAST_RATIO):
        self.points, self.norm, self.ratio = points, norm, ratio
        self.squares = (points**2).sum(axis=1)
        n = len(points)
        near = np.argsort(self._gaps(points), axis=1, kind="stable")[:, : min(NEIGHBOURS + 1, n)]
        links: list[set[int]] = [{(i + 1) % n, (i - 1) % n} for i in range(n)]  # a ring, which keeps the graph in one piece
        for i, row in enumerate(near.tolist()):
            for c in row:
                links[i].add(c)
                links[c].add(i)
        self.links = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(links)]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    @staticmethod
    def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
        rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def as_queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors * (self.norm / np.sqrt((vectors**2).sum(axis=1)))[:, None], np.zeros((len(vectors), 1))], axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, norm: float) -> Centroids:
        points, rng = cls.lift(sample, norm), np.random.default_rng(7)
        groups = [np.arange(len(points))]
        while len(groups) * 2 <= lists and min(map(len, groups)) >= 2:
            halves = []
            for g in groups:
                ends = points[g][rng.choice(len(g), 2, replace=False)]
                for _ in range(5):
                    order, half = np.argsort(points[g] @ (ends[0] - ends[1]), kind="stable"), len(g) // 2
                    ends = np.stack([points[g[order[half:]]].mean(axis=0), points[g[order[:half]]].mean(axis=0)])
                halves += [g[order[:half]], g[order[half:]]]
            groups = halves
        index = cls(np.stack([points[g].mean(axis=0) for g in groups]), norm)
        index.ratio = index._fitted_ratio(sample)
        return index

    def _fitted_ratio(self, sample: np.ndarray) -> float:
        """The ratio up to which TARGET of the K nearest, within the sample, of some of its vectors are in lists that are read. In the whole corpus the nearest are nearer, which makes them easier to find."""
        tried = sample[:TRIED]
        scores = tried @ sample.T
        scores[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        k = min(K, len(sample) - 1)
        if k < 1:
            return LEAST_RATIO
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        gaps = self._gaps(self.as_queries(tried))
        found, ids, lists = np.unique(near), *self.lists_of(sample[np.unique(near)])
        held = np.full((len(found), REPLICAS), -1)
        turn = np.arange(len(ids)) - np.searchsorted(ids, ids)
        held[ids, turn] = lists
        options = held[np.searchsorted(found, near)]  # query, neighbour, copy
        needed = np.where(options >= 0, gaps[np.arange(len(tried))[:, None, None], np.maximum(options, 0)], np.inf).min(axis=2)
        return max(LEAST_RATIO, float(np.quantile(needed / np.maximum(gaps.min(axis=1), 1e-12)[:, None], TARGET)) + 1e-9)

    def _gaps(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ self.points.T + self.squares, 0))

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, rising, and lists that those vectors go to: that of the nearest centroid, and of the next ones if the vector lies almost as near to them."""
        gaps = self._gaps(self.lift(vectors, self.norm))
        order = np.argsort(gaps, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(gaps, order, axis=1)
        i, j = np.nonzero(near <= BOUNDARY * near[:, :1] + 1e-12)
        return i, order[i, j]

    def probe(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """The lists that each query reads: a walk over the graph goes on from the nearest centroid met, as long as that is within the ratio of the nearest of all, or little beyond."""
        for query in self.as_queries(vectors):
            own, seen, best = float(query @ query), np.zeros(len(self.points), bool), math.inf
            open_: list[tuple[float, int]] = []
            within: list[tuple[float, int]] = []
            fresh, expanded = self.entries, 0
            while True:
                if len(fresh):
                    seen[fresh] = True
                    gaps = np.sqrt(np.maximum(own + self.squares[fresh] - 2 * (self.points[fresh] @ query), 0)).tolist()
                    best = min(best, *gaps)
                    for entry in zip(gaps, fresh.tolist(), strict=True):
                        heapq.heappush(open_, entry)
                if not open_ or (expanded >= BEAM and open_[0][0] > BEYOND * self.ratio * best):
                    break
                gap, c = heapq.heappop(open_)
                within.append((gap, c))
                expanded += 1
                fresh = self.links[c][~seen[self.links[c]]]
            yield np.array([c for gap, c in [*within, *open_] if gap <= self.ratio * best + 1e-12], np.int32)


def deal(sizes: np.ndarray, shard: int = SHARD, least: int = LEAST_SHARDS, chunk: int = CHUNK) -> list[np.ndarray]:
    """For each list, the shards of its chunks: lists follow each other through shards of like size, as neighbours in the order of the lists are mostly near, and a long list is cut."""
    total = int(sizes.sum())
    room = max(1, -(-total // max(least, -(-total // shard))))
    out, filled = [], 0
    for size in sizes.tolist():
        chunks = max(1, -(-size // min(chunk, room)))
        out.append(((filled + (np.arange(chunks) * size) // chunks) // room).astype(np.int32))
        filled += size
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _post(centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                at, lists = centroids.value.lists_of(_matrix(part.column("vector")))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(rows), part.column("vector").take(rows), pa.array(lists.astype(np.int32))], ["rep", "vector", "list"])

    return run


def _ask(centroids, shards: list[np.ndarray]):
    """A row for each query and shard with the lists that it reads there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                at, where, lists = [], [], []
                for i, read in enumerate(centroids.value.probe(_matrix(part.column("vector")))):
                    by_shard: dict[int, list[int]] = {}
                    for c in read.tolist():
                        for shard in set(shards[c].tolist()):
                            by_shard.setdefault(shard, []).append(c)
                    at += [i] * len(by_shard)
                    where += by_shard
                    lists += by_shard.values()
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([1] * len(at), pa.int32()), part.column("rep").take(rows), part.column("vector").take(rows), pa.array(lists, pa.list_(pa.int32()))], ["shard", "kind", "rep", "vector", "lists"])

    return run


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller one found; one that is found twice counts once."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    again = np.zeros(len(query), bool)
    again[1:] = (query[1:] == query[:-1]) & (found[1:] == found[:-1])  # copies in several lists have equal scores, so they are neighbours here
    query, found, score = query[~again], found[~again], score[~again]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], found[kept], score[kept]


class _Shard:
    """The vectors of a shard, list by list."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.spans: dict[int, tuple[int, int]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((rows.column("lists").flatten().to_numpy(), rows.column("rep").to_numpy(), _matrix(rows.column("vector"))))

    def settle(self) -> None:
        lists, self.reps, self.vectors = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(lists, kind="stable")
        lists, self.reps, self.vectors = lists[order], self.reps[order], self.vectors[order]
        names, begins = np.unique(lists, return_index=True)
        self.spans = dict(zip(names.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(lists)], strict=True), strict=True))
        self.parts = []

    def answer(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        if self.parts:
            self.settle()
        asked, lists = _matrix(rows.column("vector")), rows.column("lists")
        reader, read = np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        out = []
        for c in np.unique(read).tolist():
            if c not in self.spans:  # a chunk without vectors
                continue
            (a, b), who = self.spans[c], reader[read == c]
            held, some = self.vectors[a:b], asked[who]
            rough, take = some @ held.T, min(k, b - a)
            bar = np.partition(rough, b - a - take, axis=1)[:, b - a - take]
            q, j = np.nonzero(rough >= (bar - 1e-9 * np.abs(bar) - 1e-12)[:, None])
            out.append((who[q], self.reps[a + j], (some[q] * held[j]).sum(axis=1)))
        query, found, score = _best(*(np.concatenate(x) for x in zip(*out, strict=True)), k) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([rows.column("rep").take(pa.array(query)), pa.array(found), pa.array(score)], ["query", "found", "score"])


def _search(k: int):
    """Rows sorted by shard, its vectors first: the k best of the shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard()
        for batch in batches:
            where, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(where)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if where[a] != now:
                    now, shard = where[a], _Shard()
                if kinds[a] == 0:
                    shard.add(batch.slice(a, b - a))
                    continue
                for first in range(a, b, 256):
                    yield shard.answer(batch.slice(first, min(256, b - first)), k)

    return run


def list_count(total: int) -> int:
    """Lists for so many distinct vectors: several from two lists' worth on."""
    return 1 if total < 2 * LIST_SIZE else min(MAX_LISTS, 1 << int(math.log2(total / LIST_SIZE)))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """The k nearest of each row for which is_query holds: query_id, rank, the id found and score, ties to the smaller id; all others, if fewer.

    Rows that are not usable(), have no id, or have another number of components than most rows take no part. A row is
    no candidate of its own. An empty table gives an empty one. Rows that share an id are one vector with the values of
    any of them."""
    spark, width = vectors.sparkSession, k + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    rows = rows.where(F.size("vector") == (size["n"] if size else 0))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = rows.select("id", "vector").distinct().withColumn("turn", first).where(F.col("turn") <= width)
    distinct = written(kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector"), "vectors")
    asking = written(rows.where("asks").select("id", "vector").distinct().join(distinct.select("rep", "vector"), "vector").select("id", "rep"), "queries")

    total, norm = distinct.agg(F.count("*"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()
    lists = list_count(total)
    sample = distinct.where(unit_hash(F.col("rep"), "sample") < SAMPLE / max(total, 1)).select("rep", "vector").toArrow().sort_by("rep")["vector"].combine_chunks()
    fitted = Centroids.fit(_matrix(sample), lists, norm) if total else None
    centroids = spark.sparkContext.broadcast(fitted)  # MAX_LISTS rows at most

    kind = rows.schema["vector"].dataType.simpleString()
    postings = written(distinct.select("rep", "vector").mapInArrow(_post(centroids), f"rep long, vector {kind}, list int"), "postings")
    sizes = np.zeros(max(1, len(fitted.points) if fitted else 1), np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list
        sizes[r["list"]] = r["n"]
    shards = deal(sizes)
    table = spark.createDataFrame([(c, [int(x) for x in part]) for c, part in enumerate(shards)], "list int, places array<int>")
    chunk = F.pmod(F.xxhash64("rep"), F.size("places")).cast("int")
    held = postings.join(F.broadcast(table), "list")  # a row a list
    held = held.select(F.get("places", chunk).alias("shard"), F.lit(0).alias("kind"), "rep", "vector", F.array("list").alias("lists"))
    queries = distinct.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "vector").mapInArrow(_ask(centroids, shards), f"shard int, kind int, rep long, vector {kind}, lists array<int>")
    found = held.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(width), "query long, found long, score double")

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "found")
    top = found.groupBy("query", "found").agg(F.max("score").alias("score")).withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= width).drop("turn")
    borne = top.join(distinct.select(F.col("rep").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("other"))
    ranked = borne.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "other"))).where(F.col("turn") <= width).drop("turn")
    answers = asking.join(ranked, asking.rep == ranked.query).where("id != other").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other"))).where(F.col("rank") <= k)
    return answers.select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")
