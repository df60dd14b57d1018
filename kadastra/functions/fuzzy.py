"""Fuzzy text similarity (0 to 100) for pairs that blocking has already found: Indel ratio over token sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - bin(row).count("1")
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(one, two)
    if both:
        best = max(best, indel_ratio(both, one), indel_ratio(both, two))
    return best


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio.asNondeterministic()(a, b)  # so that a filter on the result does not run it a second time
