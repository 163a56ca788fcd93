"""The pipeline's near-dedup stage goes through operator 8's balls of fingerprints."""

import random

from terrier.llm import near_copies
from terrier.llm.simhash import RADIUS, majority

from .conftest import make


def _print(text):
    return int(majority(near_copies.shingle_set(text.encode())))


def test_balls_bring_pairs(spark):
    """Texts within the radius of each other are paired, and no others."""
    r = random.Random(4)
    rows = []
    for g in range(8):
        words = [f"g{g}w{r.randrange(10**6)}" for _ in range(900)]
        for i in range(3):
            rows.append((10 * g + i, " ".join([*words[:899], f"new{i}"] if i else words), "s"))
    bits = {i: _print(t) for i, t, _ in rows}
    within = [g for g in range(8) if any((bits[10 * g] ^ bits[10 * g + i]).bit_count() <= RADIUS for i in (1, 2))]
    assert within
    pairs = near_copies.ball_pairs(spark.createDataFrame([(i, b - (b >> 63 << 64)) for i, b in bits.items()], "node long, print long"))
    found = {(x.a, x.b) for x in pairs.collect()}
    assert found and all((bits[a] ^ bits[b]).bit_count() <= RADIUS for a, b in found)
    assert {a // 10 for a, b in found if a // 10 == b // 10} >= set(within)


def test_balls_are_verified(spark):
    """Texts of one or two shingles whose fingerprints lie near each other, or are equal, without being alike stay apart."""
    rows = [(i, f"only{i}", "s") for i in range(40)] + [(100, None, "s")]
    got = near_copies.near_copies(make(spark, rows)).collect()
    assert all(x.root.k_id == x.k_id for x in got)
