"""Operator 8: exact deduplication by a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text. Copies are counted per digest before anything is shuffled, then the digests are
dealt to buckets; each bucket keeps a cuckoo filter and the digests that it stands for. A digest that the filter has
seen is a hit only after the stored one of its bucket agrees in all 256 bits and in length; when an insertion finds
no room, the filter doubles and is filled again from the stored keys. Deletion takes a live digest out of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import materialize
from kadastra.operators.skew import join_groups

SLOTS, KICKS = 4, 200
#: Digests of one index bucket, about.
BUCKET_DIGESTS = 100_000
#: Parts in which the copies of one digest are counted before they meet in the index.
PARTS = 16


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are digests, whose bytes serve as hashes."""

    def __init__(self, capacity: int = 64):
        self.size = 1 << max(2, (max(capacity, 1) * 10 // 9 // SLOTS).bit_length())
        self.slots = np.zeros(self.size * SLOTS, np.uint16).tolist()
        self.count = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        i = int.from_bytes(digest[2:10], "big") & (self.size - 1)
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def contains(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        s = self.slots
        return mark in s[i * SLOTS : i * SLOTS + SLOTS] or mark in s[j * SLOTS : j * SLOTS + SLOTS]

    def _put(self, i: int, mark: int) -> bool:
        for k in range(i * SLOTS, i * SLOTS + SLOTS):
            if not self.slots[k]:
                self.slots[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if there is no room: the filter is then to be rebuilt from its keys."""
        mark, i, j = self._places(digest)
        self.count += 1
        if self._put(i, mark) or self._put(j, mark):
            return True
        for turn in range(KICKS):
            k = j * SLOTS + (turn * 7 + mark) % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            j = self._other(j, mark)
            if self._put(j, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        for b in (i, j):
            for k in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    self.count -= 1
                    return True
        return False


class DigestIndex:
    """Live digests of one bucket, with what is known of each: [bytes of text, id to keep, copies]."""

    def __init__(self, capacity: int = 64):
        self.filter, self.stored, self.resizes = CuckooFilter(capacity), {}, 0

    def find(self, digest: bytes, length: int) -> list | None:
        if not self.filter.contains(digest):
            return None
        found = self.stored.get(digest)
        return found if found is not None and found[0] == length else None

    def insert(self, digest: bytes, length: int, keep, copies: int) -> None:
        found = self.find(digest, length)
        if found is not None:
            found[1] = keep if found[1] is None else found[1] if keep is None else max(found[1], keep)
            found[2] += copies
            return
        self.stored[digest] = [length, keep, copies]
        fits = self.filter.insert(digest)
        while not fits:
            self.resizes += 1
            self.filter = CuckooFilter(2 * self.filter.size * SLOTS)
            fits = all(map(self.filter.insert, self.stored))

    def delete(self, digest: bytes, length: int) -> bool:
        """Take a digest out; False if it is not there."""
        if self.find(digest, length) is None:
            return False
        self.filter.delete(digest)
        del self.stored[digest]
        return True

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.stored:
            rows = pd.DataFrame([(d, *v) for d, v in self.stored.items()], columns=["digest", "n_bytes", "keep_id", "group_size"])
            yield rows.assign(keep_id=rows["keep_id"].astype("Int64"))


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = DigestIndex()
    for f in frames:
        for digest, length, keep, copies in zip(f["digest"], f["n_bytes"], f["keep_id"], f["group_size"], strict=True):
            index.insert(bytes(digest), int(length), None if pd.isna(keep) else int(keep), int(copies))
    yield from index.frames()


INDEX = "digest binary, n_bytes long, keep_id long, group_size long"


def digests(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(row_id).cast("long").alias("row_id"), F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"))


def build_index(rows: DataFrame) -> DataFrame:
    """The live digests of ``rows`` (from digests()), each with the id to keep and its copies."""
    parts = rows.groupBy("digest", "n_bytes", F.pmod(F.xxhash64("row_id"), F.lit(PARTS)).alias("part")).agg(F.max("row_id").alias("keep_id"), F.count("*").alias("group_size"))
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_DIGESTS))
    return parts.drop("part").repartition(buckets, "digest").mapInPandas(_index, INDEX)


def live_rows(rows: DataFrame) -> DataFrame:
    """The content behind an index: digest, n_bytes, row_id and how many rows are alike in these (from digests())."""
    return rows.groupBy("digest", "n_bytes", "row_id").agg(F.count("*").alias("n"))


def update_index(index: DataFrame, live: DataFrame, added: DataFrame, removed: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The index and the live rows after a batch: ``added`` and ``removed`` come from digests(), ``live`` from live_rows().

    Removing rows that are not there changes nothing. A digest that a batch touches is deleted from its bucket's index and
    inserted again from its live rows, if any are left; so the id to keep is always that of a live row.
    """
    change = live_rows(added).unionByName(live_rows(removed).withColumn("n", -F.col("n")))
    after = live.unionByName(change).groupBy("digest", "n_bytes", "row_id").agg(F.sum("n").alias("n")).where("n > 0")
    after = materialize(after, "live-digests")
    touched = added.select("digest", "n_bytes").unionByName(removed.select("digest", "n_bytes")).distinct()
    left = after.join(touched, ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes").agg(F.max("row_id").alias("keep_id"), F.sum("n").alias("group_size"))
    ops = (
        index.select("digest", "n_bytes", "keep_id", "group_size", F.lit(0).alias("what"))
        .unionByName(touched.select("digest", "n_bytes", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("what")))
        .unionByName(left.withColumn("what", F.lit(2)))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestIndex()
        for f in frames:  # by what: those there, those touched, those that live
            for what, digest, length, keep, copies in zip(f["what"], f["digest"], f["n_bytes"], f["keep_id"], f["group_size"], strict=True):
                if what == 1:
                    index.delete(bytes(digest), int(length))
                else:
                    index.insert(bytes(digest), int(length), None if pd.isna(keep) else int(keep), int(copies))
        yield from index.frames()

    return ops.repartition(buckets, "digest").sortWithinPartitions("what").mapInPandas(run, INDEX), after


def exact_dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: row id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays. Null texts equal empty ones. A null id stays only if all ids of its group
    are null; rows that repeat an id and a text are one document seen twice, and are kept or dropped together. An
    empty table gives an empty result; columns other than the two named are not read.
    """
    rows = materialize(digests(docs, text, row_id), "digests")
    index = materialize(build_index(rows), "digest-index").drop("n_bytes")
    joined = join_groups(rows.drop("n_bytes"), index, "digest", "group_size")
    return joined.select(F.col("row_id").alias(row_id), "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
