"""Operator 7: language identification by a blended-spectrum string kernel.

A text is the set of its character n-grams, n = 1, 2, 3 (case folded, other than letters taken as one space); the
kernel of two texts is the number of n-grams they share over the geometric mean of their numbers. A bounded, hash
chosen set of labelled texts serves as Nystroem landmarks: K(x, landmarks) K(landmarks, landmarks)^(-1/2) are the
coordinates in which one-versus-rest kernel ridge regression is solved from partition-summed normal equations.
Scoring is one matrix product of presence rows with the landmarks' presence and one with the weights, by batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.llm.common import materialize, sample_rate
from kadastra.llm.models import normal_equations, ridge
from kadastra.llm.toxicity import remainder

ORDERS = (1, 2, 3)
#: N-grams are hashed to this many cells (a power of two); cells that no landmark has are not kept. A text of n distinct
#: n-grams has about n * n / (2 * CELLS) collisions: 15 of 1,000.
CELLS = 1 << 15
#: Labelled rows that the model is fitted on (about), and landmarks among them, or one for each language if these are more.
MAX_FIT, LANDMARKS = 10_000, 160
#: Rows of each language that are in the fit at least (about), if it has so many.
LEAST_FIT = 50
#: Languages of which a model is made; more are refused.
MAX_LANGUAGES = 10_000
#: Code points read at once.
CHUNK = 1 << 20
STRENGTH = 1e-3


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_LETTER = np.zeros(0x110000, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER[points]


def cells(text: str, marks: np.ndarray) -> bool:
    """Mark the cells of a text's n-grams in ``marks`` (CELLS booleans); False if it has no letter."""
    points, tail, found = _points(text), np.zeros(0, np.uint64), False
    for at in range(0, len(points), CHUNK):
        p = points[at : at + CHUNK]
        letter = _letters(p)
        found = found or bool(letter.any())
        p = np.where(letter, p, 32).astype(np.uint64)
        keep = np.ones(len(p), bool)
        keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
        p = np.concatenate([tail, p[keep]])
        h = np.zeros(len(p), np.uint64)
        for n in ORDERS:
            if len(p) < n:
                break
            h = (h[: len(p) - n + 1] if n == 1 else h[:-1]) * np.uint64(0x9E3779B97F4A7C15) + p[n - 1 :] + np.uint64(n)
            marks[((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)] = True
        tail = p[-(max(ORDERS) - 1) :]
    return found


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # cells that some landmark has
    landmarks: np.ndarray  # vocabulary x landmarks, presence over root of count
    root: np.ndarray  # K(landmarks, landmarks)^(-1/2)
    weights: np.ndarray  # coordinates x languages

    def coordinates(self, texts) -> tuple[np.ndarray, np.ndarray]:
        texts = list(texts)
        out, letters = np.zeros((len(texts), self.landmarks.shape[1])), np.zeros(len(texts), bool)
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            rows, sizes = np.zeros((len(some), len(self.vocabulary)), np.float32), np.ones(len(some))
            for i, t in enumerate(some):
                marks = np.zeros(CELLS, bool)
                letters[at + i] = cells(t or "", marks)
                rows[i] = marks[self.vocabulary]
                sizes[i] = max(1, marks.sum())
            out[at : at + 256] = (rows @ self.landmarks) / np.sqrt(sizes)[:, None]
        return out @ self.root, letters

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        x, letters = self.coordinates(texts)
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x))
        raw = x @ self.weights
        e = np.exp(8 * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        score = e[np.arange(len(x)), best] / e.sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", most: int = MAX_FIT, landmarks: int = LANDMARKS) -> Model:
    """A model of all rows with text and language, or of about ``most`` of them chosen by a hash of row id and text; of each
    language LEAST_FIT at least."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(row_id).alias("row_id"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.eye(1), np.zeros((1, 0)))
    rate = sample_rate(sum(r["count"] for r in counts), most)
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(rate, sample_rate(r["count"], LEAST_FIT))) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64(F.lit("language"), "row_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = materialize(rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("text", "lang"), "language-fit")
    each = max(1, landmarks // len(languages))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    chosen = [r["text"] for r in rows.distinct().withColumn("nth", nth).where(F.col("nth") <= each).orderBy("lang", "nth").collect()]
    presence = np.zeros((len(chosen), CELLS), bool)
    for i, t in enumerate(chosen):
        cells(t, presence[i])
    presence = presence[presence.any(axis=1)] if presence.any() else presence[:1]
    vocabulary = np.flatnonzero(presence.any(axis=0))
    unit = (presence[:, vocabulary] / np.sqrt(np.maximum(1, presence.sum(axis=1)))[:, None]).astype(np.float32).T
    values, vectors = np.linalg.eigh((unit.T @ unit).astype(float))
    ok = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, ok] / np.sqrt(values[ok])
    model = Model(languages, vocabulary, unit, root, np.zeros((root.shape[1], len(languages))))

    def design(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, _ = model.coordinates(f["text"])
        return x, np.where(f["lang"].to_numpy()[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)

    model.weights = ridge(*normal_equations(rows.repartition(16), design, root.shape[1], len(languages)), STRENGTH)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names. Null texts and texts without a letter: ``und``
    with score 0. Of languages with equal scores the first by code point is taken."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                names, score = model.predict(f[text])
                yield f.assign(lang_pred=names, score=score)

    return docs.mapInPandas(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; repeated rows repeat; a null id is not held out and never trains."""
    from kadastra.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
