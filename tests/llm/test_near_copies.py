"""The pipeline's near-dedup stage against brute force over shingle sets."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terrier.llm import near_copies

from .conftest import make
from .test_text_operators import _components


def _shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _like(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def _edited(words, n, r):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**6)}"
    return out


def test_near_dedup_stage_drops_what_is_alike(spark):
    import corpus_pipeline

    r = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(300)}" for _ in range(200)]
        rows += [(100 * g + i, " ".join(_edited(base, (0, 2, 3, 4, 12)[i % 5], r)), "s") for i in range(10)]
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "A few words", "s"), (5003, "a few  words", "s")]
    sets = {i: _shingles(t) for i, t, _ in rows}
    roots = _components(sorted(sets), lambda a, b: _like(sets[a], sets[b]))
    kept = corpus_pipeline.near_dedup(spark, make(spark, rows).repartition(4), "")
    assert Counter(x.doc_id for x in kept.collect()) == Counter(set(roots.values()))
    assert len(set(roots.values())) < 60


def test_large_group_without_a_centre(spark):
    """A chain: next ones are alike, far ones are not, so that no single text is alike to all of a bucket."""
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200]), "s") for i in range(120)]
    rows += [(1000 + i, " ".join(words[4 * i : 4 * i + 200]).upper(), None) for i in range(120)]
    got = near_copies.near_copies(make(spark, rows)).collect()
    sets = {i: _shingles(t) for i, t, _ in rows}
    roots = _components(sorted(sets), lambda a, b: _like(sets[a], sets[b]))
    assert {x.k_id: x.root.k_id for x in got} == roots


def test_near_copies_of_odd_rows(spark, docs, rows, empty):
    low = -(2**63)
    got = near_copies.near_copies(docs).collect()
    assert len(got) == len(rows)
    sets = {(low if i is None else i, n): _shingles(t) for n, (i, t, _) in enumerate(rows)}
    roots = _components(sorted(sets), lambda a, b: _like(sets[a], sets[b]))
    assert Counter((x.k_id, x.root.k_id) for x in got) == Counter((a[0], b[0]) for a, b in roots.items())
    left = near_copies.drop_near_copies(docs)
    assert left.columns == docs.columns and near_copies.drop_near_copies(empty).count() == 0


def test_bitmaps_bound_the_similarity_from_above(spark):
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    rows, true = [], []
    for n in (0, 1, 5, 40, 200, 2000):
        for share in (0.0, 0.5, 0.8, 1.0):
            a = np.unique(r.choice(pool, n, replace=False))
            b = np.unique(np.concatenate([a[: int(n * share)], r.choice(pool, n - int(n * share), replace=False)]))
            if len(a) and len(b):
                rows.append((len(rows), len(a), near_copies.bitmap(a), len(b), near_copies.bitmap(b)))
                true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    df = spark.createDataFrame(rows, "i int, n int, x array<long>, m int, y array<long>")
    words = lambda c: [F.col(c)[i] for i in range(near_copies.BITMAP)]
    got = [x.b for x in df.orderBy("i").select(near_copies._at_most(F.col("n"), words("x"), F.col("m"), words("y")).alias("b")).collect()]
    assert all(g >= t - 1e-12 for g, t in zip(got, true, strict=True))
    assert sum(g < 0.8 for g, t in zip(got, true, strict=True) if t < 0.5) >= 5
