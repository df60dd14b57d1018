"""Operator 3: a quality classifier on random Fourier features of document statistics.

A document is described by a few statistics of its whole text (shares of character classes, word and line lengths,
repetition). Their standardised values z give features sqrt(2/D) cos(w z + b) with Gaussian w, whose inner products
approximate a Gaussian kernel. Every partition sums its part of the normal equations, for two halves of the rows apart;
ridge regression on the sums gives scores, and isotonic calibration a probability. It is fitted on scores that each half
gets from the other one's weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import by_hash, materialize, sample_rate
from kadastra.llm.models import calibrated, isotonic, normal_equations, ridge
from kadastra.llm.toxicity import remainder

#: Labelled rows that the model is fitted on, at most (about); chosen by a hash of their ids.
MAX_FIT = 30_000
#: Random features.
WIDTH, SEED = 320, 7
STRENGTH = 3e-4
#: Code points read at once.
CHUNK = 1 << 20

LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, NEWLINE, STOP, SYMBOL, REST = range(9)
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASS:
        table = np.full(0x110000, REST, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            table[c] = NEWLINE if s == "\n" else SPACE if s.isspace() else DIGIT if s.isdigit() else UPPER if s.isupper() else LOWER if s.islower() else OTHER_LETTER if s.isalpha() else STOP if s in ".,;:'’-()" else SYMBOL if 32 < c < 127 else REST
        _CLASS.append(table)
    return _CLASS[0]


STATISTICS = 20


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, each finite; those of an empty text are zero."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(9)
    for at in range(0, len(points), CHUNK):
        counts += np.bincount(_classes()[points[at : at + CHUNK]], minlength=9)
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, chars = len(words), max(1.0, counts.sum())
    letters = max(1.0, counts[LOWER] + counts[UPPER] + counts[OTHER_LETTER])
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = len(seen)
    lengths = np.fromiter(map(len, words), np.int64, n)
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n),
        counts[UPPER] / letters,
        counts[DIGIT] / chars,
        counts[STOP] / n,
        counts[SYMBOL] / n,
        text.count("!") / n,
        text.count("|") / n,
        sum(map(text.count, "$%&*#")) / n,
        text.count(".") / n,
        letters / n,
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 15).mean()),
        kinds / n,
        np.log(n) * kinds / n,
        max(seen.values()) / n,
        runs / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        counts[REST] / chars,
    ]


def _table(texts) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts]).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def score(self, texts) -> np.ndarray:
        return calibrated(self.expand(_table(texts)) @ self.weights, self.knots, self.values)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality", most: int = MAX_FIT, seed: int = SEED) -> Model:
    """A model of ``docs`` whose ids have a label 0 or 1; ``most`` of them at most (about). Of several labels the largest counts."""
    marks = labels.where(F.col(row_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(row_id).alias("of")).agg(F.max(label).cast("double").alias("label"))
    marks = materialize(marks.where(by_hash(sample_rate(marks.count(), most), "of", salt="quality")), "quality-labels")
    rows = docs.select(F.col(row_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(marks), "of")  # about ``most`` small rows

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"x": list(_table(f["text"])), "label": f["label"], "fold": f["fold"]})

    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "of"), F.lit(2)).cast("int"))
    rows = materialize(rows.mapInPandas(measure, "x array<double>, label double, fold int"), "quality-fit")
    each = [F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s")).alias(f"c{i}") for i in range(STATISTICS)]
    found = rows.agg(*each).first()
    mean, scale = (np.array([float(found[f"c{i}"][k] or 0.0) for i in range(STATISTICS)]) for k in "ms")
    random = np.random.default_rng(seed)
    w = random.normal(size=(STATISTICS, WIDTH)) / np.sqrt(STATISTICS)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, random.uniform(0, 2 * np.pi, WIDTH), np.zeros(WIDTH + 1), np.array([0.0]), np.array([0.5]))

    def design(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return model.expand(np.array(f["x"].tolist()).reshape(-1, STATISTICS)), f["label"].to_numpy(float)[:, None]

    sums = [normal_equations(rows.where(F.col("fold") == k).repartition(16), design, WIDTH + 1, 1) for k in (0, 1)]
    weights = [ridge(*s, STRENGTH)[:, 0] for s in sums]
    model.weights = ridge(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1], STRENGTH)[:, 0]

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, y = design(f)
            other = np.stack(weights, axis=1)[:, 1 - f["fold"].to_numpy()]
            yield pd.DataFrame({"score": (x * other.T).sum(axis=1), "label": y[:, 0]})

    model.knots, model.values = isotonic(rows.mapInPandas(raw, "score double, label double"))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of quality 1, in place of a column of that name; a null text counts as empty, and empty texts are scored like any other."""
    docs = docs.drop(into)
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{into: model.score(f[text])})

    return docs.mapInPandas(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; repeated rows repeat; a null id is not held out and never trains; without labels all scores are 0.5."""
    from kadastra.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
