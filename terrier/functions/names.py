"""Similarity of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the measure.
PREFIX_SCALE, PREFIX_MOST = 0.1, 4


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, matched = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, f in zip(b, free, strict=True) if not f]
    m, moved = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def common_prefix(a: Column, b: Column, most: int = PREFIX_MOST) -> Column:
    """How many characters two texts share from the start, `most` at most."""
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, most + 1)]
    long_enough = [(F.length(a) >= k) & (F.length(b) >= k) for k in range(1, most + 1)]
    return sum((F.when(s & n, 1).otherwise(0) for s, n in zip(same, long_enough, strict=True)), F.lit(0))


def jaro_winkler(a: Column, b: Column, scale: float = PREFIX_SCALE) -> Column:
    """With the bonus for a common prefix whatever the score is."""
    j = jaro(a, b)
    return j + common_prefix(a, b) * scale * (1 - j)


def can_reach(a: Column, b: Column, least: float, scale: float = PREFIX_SCALE) -> Column:
    """Whether jaro_winkler() of two texts may be `least` or more, by their lengths, their common prefix and the letters of each that the other has at all: never false where it is. Columns only, so that few pairs are left to be worked out."""
    left = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))  # noqa: E731  letters of x that y has, too
    common = F.least(left(a, b), left(b, a))
    bonus = common_prefix(a, b) * scale
    needed = 3 * (least - bonus) / (1 - bonus) - 1
    return (a == b) | ((F.length(a) > 0) & (F.length(b) > 0) & (common / F.length(a) + common / F.length(b) >= needed - 1e-9))


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda t: t != "")), " ")
