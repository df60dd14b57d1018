"""Small linear algebra shared by the classifiers: partition-summed normal equations, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of equal counts in which scores are pooled before isotonic regression.
BINS = 400


def normal_equations(rows: DataFrame, design: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], width: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum X'X and X'Y over all rows; ``design`` makes (X, Y) of a frame.

    Every partition sums its own rows and emits the matrix row by row; Spark sums those by row number. The result has
    ``width`` rows whatever the number of documents.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + outputs))
        for f in frames:
            x, y = design(f)
            total += x.T @ np.concatenate([x, y], axis=1)
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.stack(frame["row"].to_numpy()).sum(axis=0)]})

    schema = "i int, row array<double>"
    found = rows.mapInPandas(partial, schema).groupBy("i").applyInPandas(add, schema).toPandas().sort_values("i")
    if found.empty:
        return np.zeros((width, width)), np.zeros((width, outputs))
    both = np.stack(found["row"].to_numpy())
    return both[:, :width], both[:, width:]


def ridge(xx: np.ndarray, xy: np.ndarray, strength: float) -> np.ndarray:
    scale = max(np.trace(xx) / len(xx), 1e-12)
    return np.linalg.solve(xx + strength * scale * np.eye(len(xx)), xy)


def isotonic(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Calibration of (score, label) rows: knots and non-decreasing probabilities, for np.interp.

    Scores are pooled in BINS bins (edges from approximate quantiles), which is all that reaches the driver; adjacent
    violators are pooled there. Probabilities are smoothed by half a row of each label.
    """
    edges = sorted(set(scored.approxQuantile("score", [i / BINS for i in range(1, BINS)], 0.0005)))
    cuts = np.array(edges)

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(bin=np.searchsorted(cuts, f["score"].to_numpy()).astype(np.int32))

    binned = scored.select("score", F.col("label").cast("double").alias("label")).mapInPandas(pooled, "score double, label double, bin int")
    rows = binned.groupBy("bin").agg(F.avg("score").alias("score"), F.sum("label").alias("hits"), F.count("*").alias("n")).orderBy("bin").collect()
    if not rows:
        return np.array([0.0]), np.array([0.5])
    blocks: list[list[float]] = []  # mean score, hits, rows
    for r in rows:
        blocks.append([r["score"], r["hits"], r["n"]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s, h, n = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[2] + s * n) / (p[2] + n), p[1] + h, p[2] + n]
    knots, values = np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return knots, np.maximum.accumulate(values)


def calibrated(score: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Interpolated probability; beyond the outer knots it goes on a little, so that order is kept."""
    inner = np.interp(score, knots, values)
    below, above = np.minimum(score - knots[0], 0.0), np.maximum(score - knots[-1], 0.0)
    return np.clip(np.where(below < 0, values[0] * np.exp(below), np.where(above > 0, 1 - (1 - values[-1]) * np.exp(-above), inner)), 0.0, 1.0)
