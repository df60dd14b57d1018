"""Operator 4: mixing sources to target weights by cube-method balanced sampling.

Each source has a target in words. A document's expected number of copies is its source's target over its source's
size; the whole part is taken for certain, the fraction by the cube method: the fractions of undecided documents move
along the null space of the two balancing constraints (documents and words), up or down at random so that each fraction is
kept on average, until one of them reaches 0 or 1. The direction is the longest undecided document's, projected into the
null space, so long documents are decided first and the others make up for them; a few short ones are left.

Documents fly in hash buckets of their source; what each bucket leaves undecided (LANDING documents at most) flies again in
fewer buckets, round by round, until one bucket a source is left. Its last documents are landed by trying all outcomes. Texts are never shuffled; only id, source, size and a hash are.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import materialize, word_count

#: Weights of the sources by code point of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is taken more often than this.
MOST = 3.0
#: Documents of one bucket, about.
BUCKET_ROWS = 256
#: Documents of a source that are left to landing, and the share of its target that counts as no miss in words there.
LANDING, NEAR = 8, 0.001
#: Sources whose totals the driver will hold; more are refused.
MAX_SOURCES = 1_000_000
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        rate = left / sum(weights[i] for i in free)
        over = {i for i in free if rate * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = rate * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        left = max(left, 0.0)
        free -= over
    return out


def direction(sizes: np.ndarray, p: np.ndarray, lead: int) -> np.ndarray:
    """The unit vector of ``lead`` projected into the null space of (1, sizes), in the metric of the room p (1 - p); zero if
    that space leaves the document no way to move."""
    room = p * (1 - p)
    total, first, second = room.sum(), room @ sizes, room @ (sizes * sizes)
    spread = total * second - first * first
    own = np.array([1.0, sizes[lead]]) * room[lead]
    if spread > 1e-12 * total * second:
        a, b = (second * own[0] - first * own[1]) / spread, (total * own[1] - first * own[0]) / spread
    else:  # sizes alike: one constraint
        a, b = own[0] / total, 0.0
    out = -room * (a + b * sizes)
    out[lead] += room[lead]
    return out if abs(out[lead]) > 1e-9 * room[lead] else np.zeros(len(p))


def flight(sizes: np.ndarray, p: np.ndarray, toss: Callable[[], float], stop: int = 2) -> np.ndarray:
    """Move fractions through the null space of (documents, words) until ``stop`` documents at most are undecided.

    Each move has two ends, one up and one down; which is taken is tossed (``toss`` gives numbers in [0, 1)) so that the
    fractions are kept on average. Documents are looked at in the order given."""
    p = np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p.astype(float)))
    at = np.flatnonzero((p > 0) & (p < 1))
    scale = max(float(sizes.max()), 1.0) if len(sizes) else 1.0
    while len(at) > max(stop, 2):
        now, s = p[at], sizes[at] / scale
        for lead in range(len(at)):
            u = direction(s, now, lead)
            if u.any():
                break
        else:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - now) / u, np.where(u < 0, now / -u, np.inf)).min()
            down = np.where(u < 0, (1 - now) / -u, np.where(u > 0, now / u, np.inf)).min()
        now = now + (up if toss() * (up + down) < down else -down) * u
        now = np.where(now <= EPS, 0.0, np.where(now >= 1 - EPS, 1.0, now))
        p[at] = now
        at = at[(now > 0) & (now < 1)]
    return p


def land(sizes: np.ndarray, p: np.ndarray, near: float = 0.0) -> np.ndarray:
    """Decide the few documents left: of all outcomes, the nearest in words (misses of up to ``near`` are alike), then in documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    outcomes = np.array(list(product((0.0, 1.0), repeat=len(at)))).reshape(-1, len(at))
    words = np.abs((outcomes - p[at]) @ sizes[at])
    count = np.abs((outcomes - p[at]).sum(axis=1))
    p = p.copy()
    p[at] = outcomes[np.lexsort((words, np.round(count, 9), np.maximum(words - near, 0)))[0]]
    return p


def _fly(seed: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "o", "row_id", "copy"], ascending=[False, True, True, True], ignore_index=True)
        name = group["source"].iloc[0]
        random = np.random.default_rng([seed, turn, int(group["bucket"].iloc[0]), xxhash.xxh64_intdigest("" if name is None else f"s{name}")])
        return group.assign(p=flight(group["size"].to_numpy(float), group["p"].to_numpy(float), random.random, LANDING))

    return run


def _land(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "o", "row_id", "copy"], ascending=[False, True, True, True], ignore_index=True)
    return group.assign(p=land(group["size"].to_numpy(float), group["p"].to_numpy(float), NEAR * float(group["target"].iloc[0])))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, text: str = "text", row_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """How many copies of each document the mix takes: row id, size, source_size, target, copies, taken and landed.

    ``landed`` marks the documents (LANDING at most in a source) that were decided by landing and not in flight. Null and empty
    texts have size 0 and are never taken; a null source is a source of its own, ordered last; null ids and repeated rows
    are rows like any other (rows equal in id, source and text are numbered, and may differ in copies); an empty table gives
    an empty result. Columns other than the three named are not read. ``seed`` chooses another of the possible mixes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(text), F.col(row_id)).alias("o"))
    rows = materialize(rows.groupBy("row_id", "source", "size", "o").agg(F.count("*").alias("n")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    found = targets([r["source_size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = spark.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(totals, found, strict=True)], "of string, source_size long, target double")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + F.lit(EPS)).cast("long"))
    planned = planned.select("row_id", "source", "size", "o", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "source_size", "target", "base", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")).alias("p"), F.lit(False).alias("landed"))
    decided, flying, turn, most_buckets = planned.where("p <= 0"), planned.where("p > 0"), 0, 2
    while most_buckets > 1:
        counts = flying.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("of"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
        counts = materialize(counts, "mix-buckets")  # a row for each source
        most_buckets = counts.agg(F.max("buckets")).first()[0] or 0
        bucket = F.pmod(F.xxhash64("row_id", "o", "copy", F.lit(turn)), F.col("buckets"))
        dealt = flying.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket).drop("of", "buckets")
        flown = materialize(dealt.groupBy("source", "bucket").applyInPandas(_fly(seed, turn), dealt.schema).drop("bucket"), "mix-flight")
        decided, flying, turn = decided.unionByName(flown.where("p <= 0 or p >= 1")), flown.where("p > 0 and p < 1"), turn + 1
    landed = flying.groupBy("source").applyInPandas(_land, flying.schema).withColumn("landed", F.lit(True))  # LANDING rows a source at most
    copies = (F.col("base") + F.round("p").cast("long")).cast("long")
    return decided.unionByName(landed).select(F.col("row_id").alias(row_id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "landed")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "landed")
