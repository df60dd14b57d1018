"""Operator 13: periodic runs of words, by heavy/light lag counting.

For each document the matches of all lags (word i equals word i + lag) are counted exactly, without looking at each lag:
frequent words by one FFT autocorrelation of their summed power spectra, rare words by the differences of their positions.
A run of period q and length l has l - q matches in a row, so only lags with that many matches are looked at. For these the
islands of matches are found; one that is long enough is a run unless its period is a multiple of a smaller one.

Lags are taken in ascending order, and a run's matches at the multiples of its period are taken off their counts: two
stretches, one with period q and one with a proper divisor of q, overlap in fewer than q words, so none of those matches can
belong to a run of period q. A text that says one word a million times has one lag looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import WORD, table, word_count

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words more frequent than the square root of n log n, and than this, count as heavy.
LEAST_HEAVY = 64
#: Places of a possible island that are compared before a lag is scanned.
PROBES = 24

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lag_counts(words: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to ``most`` the number of i with words[i] == words[i + lag]; lag 0 is left 0."""
    n, counts = len(words), np.zeros(most + 1, np.int64)
    sizes = np.bincount(words)
    heavy = sizes > max(LEAST_HEAVY, int((n * np.log2(n + 1)) ** 0.5))
    order = np.argsort(words, kind="stable")
    sorted_ = words[order]
    if heavy.any():
        light = ~heavy[sorted_]
        order, sorted_ = order[light], sorted_[light]
        length = 1 << (n + most).bit_length()
        power = np.zeros(length // 2 + 1)
        for w in np.flatnonzero(heavy):
            f = np.fft.rfft(words == w, length)
            power += f.real**2 + f.imag**2
        counts[1:] += np.rint(np.fft.irfft(power, length)[1 : most + 1]).astype(np.int64)
    ahead, at = 1, np.arange(len(order))
    while True:  # pairs of positions of a word, the next one, the one after the next, ...
        at = at[: np.searchsorted(at, len(order) - ahead)]
        at = at[sorted_[at] == sorted_[at + ahead]]
        lag = order[at + ahead] - order[at]
        near = lag <= most
        at = at[near]
        if not len(at):
            return counts
        counts += np.bincount(lag[near], minlength=most + 1)
        ahead += 1


def _prime_divisors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + [q] if q > 1 else out


def _islands(words: np.ndarray, q: int, need: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches of ``need`` or more positions i with words[i] == words[i + q]."""
    if q > 1:  # such a stretch holds three multiples of q, and all between them
        marks = words[::q]
        same = marks[1:] == marks[:-1]
        at = q * np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        for step in np.unique(np.linspace(1, 2 * q, PROBES).astype(np.int64)):
            if not len(at):
                return
            at = at[words[at + step] == words[at + step + q]]
        if not len(at):
            return
    edges = np.flatnonzero(np.diff(np.r_[0, (words[q:] == words[:-q]).view(np.int8), 0]))
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= need
    yield from zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words, by start, then period."""
    n = len(words)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS or not most:
        return []
    counts, lags = lag_counts(words, most), np.arange(most + 1)
    need = np.maximum(LEAST_WORDS, LEAST_PERIODS * lags) - lags
    out = []
    for q in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[q] < need[q]:  # since taken by runs of a smaller period
            continue
        for start, end in _islands(words, q, int(need[q])):
            if any(np.array_equal(words[start : start + q], words[start + d : start + d + q]) for d in (q // r for r in _prime_divisors(q))):
                continue
            length = end - start + q
            out.append((start, length, q))
            multiples = np.arange(2 * q, min(most, length - 1) + 1, q)
            counts[multiples] -= length - multiples
    return sorted(out, key=lambda r: (r[0], r[2]))


def _of_text(text: str) -> tuple[list[tuple[int, int, int]], str]:
    said = text.encode("utf-8", "surrogatepass").split()  # bytes split at just the six separators
    seen: dict[bytes, int] = {}
    found = runs(np.fromiter((seen.setdefault(w, len(seen)) for w in said), np.int64, len(said)))
    if found:
        gone = np.zeros(len(said) + 1, np.int64)
        for start, length, q in found:
            gone[start + q] += 1
            gone[start + length] -= 1
        said = [said[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
    return found, b" ".join(said).decode("utf-8", "surrogatepass")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [_of_text(t or "") for t in f["text"]]
        yield pd.DataFrame({"row_id": f["row_id"], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in x] for x, _ in found], "collapsed": [x for _, x in found]})


def find_runs(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: row id (as a long), ``runs`` by start, then period, and ``collapsed``, the text's words, joined by one
    space, without those that a run holds after its first period.

    A null text counts as empty; texts of fewer than six words have no run. Rows are judged for themselves, so rows without an
    id and repeated ones are returned as they are; an empty table gives an empty result; columns other than the two named are
    not read. The work on one text grows with n log n for its frequent words and n times the square root of n log n at most for
    the rare ones; a text is held by one task.
    """
    source = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return source.mapInPandas(_runs, f"row_id long, runs {RUNS}, collapsed string").withColumnRenamed("row_id", row_id)


def longest(found: Column) -> Column:
    """The longest of the runs, of such the first, of these the one of the smallest period; null if there is none."""
    order = F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(order)
    return F.when(F.size(found) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_echoes(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Documents in which one in ten, by the checksum of its id, repeats: from word a on, with period p. A row without an id is
    left as it is."""
    h = F.crc32(F.col(row_id).cast("string"))
    n, g = word_count(F.col(text)), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    said = F.regexp_extract_all(F.col(text), F.lit(WORD), 0)
    again = F.flatten(F.array_repeat(F.slice(said, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    echoed = F.concat(F.slice(said, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), F.array_join(echoed, " ")).otherwise(F.col(text)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_echoes(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = longest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
