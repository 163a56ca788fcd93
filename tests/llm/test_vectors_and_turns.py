"""Nearest neighbours, chat formatting and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.llm import chat_format, posting_ann


def _nearest(rows, k):
    out = {}
    for q, v in rows:
        scored = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_ann_small_and_odd(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(60)] + [(100 + i, [1.0] * 6) for i in range(40)]
    odd = [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("inf")] * 6), (905, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label string, rep int")
    got = {}
    for x in posting_ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    want = {q: v for q, v in _nearest(rows, 20).items() if q % 20 == 0}
    assert {q: [v[i][0] for i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(got[q][n + 1][1] == pytest.approx(s, abs=1e-12) for q, v in want.items() for n, (_, s) in enumerate(v))
    few = df.where("vec_id in (0, 1, 2)")
    assert posting_ann.nearest(few, F.lit(True)).count() == 6
    assert posting_ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_ann_recall(spark):
    """With several lists: at least nine tenths of the true neighbours."""
    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for row in posting_ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    scores = x[::20].astype(float) @ x.T.astype(float)
    hits = 0
    for n, q in enumerate(range(0, 6000, 20)):
        scores[n, q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores[n])[:20].tolist()))
    assert hits / (20 * len(found)) >= 0.9 and len(found) == 300


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[", "<<SYS>>\n", " [/INST]", "", None, "a\nb\\\\<s>", "é<", "[TURN=x] y [/TURN]"]
    rows = [(1, i, ("system", "user", "assistant", "tool]", None, "x[y")[i % 6], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 1, "assistant", "yo"), (None, None, "user", "null"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in (1, 2, None, 3):
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not got[2].valid and not got[3].valid and got[None].valid
    segments = chat_format.format_conversations(df).collect()
    assert got[1].formatted_chars == sum(len(s.text) for s in segments if s.conv_id == 1)
    assert Counter(s.loss for s in segments if s.conv_id == 2) == {True: 2, False: 7}
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.agg(F.sum("length")).first()[0] == last.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def _recall(x, found):
    scores = x[::20].astype(float) @ x.T.astype(float)
    scores[np.arange(len(scores)), np.arange(0, len(x), 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    return np.mean([len(found[20 * n] & set(w.tolist())) / 20 for n, w in enumerate(want)])


def test_ann_reads_few_of_clustered_vectors(spark):
    """On 24,000 vectors in 300 clusters: recall of 0.95 or more, under a fifth of all entries read, few copies."""
    r = np.random.default_rng(8)
    x = (r.normal(size=(300, 48))[r.integers(0, 300, 24_000)] + 0.25 * r.normal(size=(24_000, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for row in posting_ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    assert len(found) == 1200 and _recall(x, found) >= 0.95
    norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
    index = posting_ann.Centroids.fit(x[:20_000].astype(float), posting_ann.list_count(len(x)), norm)
    _, lists = index.lists_of(x.astype(float))
    sizes = np.bincount(lists, minlength=len(index.points))
    read = [sizes[c].sum() for c in index.probe(x[::60].astype(float))]
    assert np.mean(read) < 0.2 * len(x) and sizes.sum() < 2.5 * len(x)


def test_ann_walk_finds_the_lists_within_the_ratio():
    """Of all centroids within the ratio, measured one by one, the walk meets nearly all, and no other."""
    r = np.random.default_rng(4)
    x = r.normal(size=(1000, 64))
    norm = float(np.sqrt((x**2).sum(axis=1).max()))
    index = posting_ann.Centroids(posting_ann.Centroids.lift(x, norm), norm, ratio=1.1)
    asked = r.normal(size=(60, 64))
    gaps = index._gaps(index.as_queries(asked))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(gaps <= 1.1 * gaps.min(axis=1)[:, None])), strict=True))
    got = {(i, c) for i, lists in enumerate(index.probe(asked)) for c in lists.tolist()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_ann_boundary_vectors_only_are_replicated():
    index = posting_ann.Centroids(np.array([[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]), 1.0)
    at, lists = index.lists_of(np.array([[0.1, 0.0], [0.5, 0.0], [0.95, 0.0]]))
    gaps = index._gaps(index.lift(np.array([[0.1, 0.0], [0.5, 0.0], [0.95, 0.0]]), 1.0))
    assert list(zip(at.tolist(), lists.tolist(), strict=True)) == [(i, c) for i in range(3) for c in np.argsort(gaps[i]).tolist() if gaps[i, c] <= posting_ann.BOUNDARY * gaps[i].min()]
    assert len(set(at.tolist())) == 3


def test_ann_shards_are_of_like_size():
    sizes = np.array([5, 0, 100, 40_000, 7, 3])
    shards = posting_ann.deal(sizes, shard=1000, least=4, chunk=500)
    assert len(shards) == 6 and all(len(s) >= 1 for s in shards)
    load = np.zeros(60)
    for size, some in zip(sizes, shards, strict=True):
        np.add.at(load, some, size / len(some))
    assert load.max() <= 2000 and (load > 0).sum() >= 38


def test_ann_uses_lists_as_soon_as_two_can_be_formed():
    assert [posting_ann.list_count(n) for n in (0, 1, 399, 400, 500, 800, 10**9)] == [1, 1, 1, 2, 2, 4, posting_ann.MAX_LISTS]
