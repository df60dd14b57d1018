"""Operator 9: SimHash near-duplicates, joined by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 22, 21 and 21 bits. Each segment is read as a word of the
perfect (23, 12) Golay code and decoded to the index of its codeword; near(s) are the indices to which the segment
and all words one bit away decode (6 at most). Two segments one bit apart have the index of either among the near
ones of the other, and two segments two bits apart share the index of the word between them.

Of four errors over three segments, two segments together have two at most. So for each pair (a, b) of segments the
keys index(a) x near(b) and near(a) x index(b) suffice: errors (0,2) and (2,0) meet within one kind of keys, (1,1)
across both. Fingerprints that share a 24-bit key are compared; within a key, a search over those not yet reached
gives a spanning forest, never all pairs. Keys with more fingerprints than a task should hold are dealt to blocks, and each
two blocks meet. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import materialize
from kadastra.operators.graph import connected_components
from kadastra.operators.skew import join_groups

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a key, or of a block of a larger one, about; and such larger keys that are broadcast at most.
BLOCK, BROADCAST_KEYS = 8192, 1_000_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Decoding of 23-bit words to the 12-bit indices of their codewords, vectorised."""

    def __init__(self):
        self.parity = np.array([_remainder(m << 11) for m in range(1 << 12)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        bits = [1 << i for i in range(23)]
        for i, a in enumerate(bits):
            self.error[_remainder(a)] = a
            for j, b in enumerate(bits[:i]):
                self.error[_remainder(a | b)] = a | b
                for c in bits[:j]:
                    self.error[_remainder(a | b | c)] = a | b | c

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.parity[words >> 11] ^ (words & 0x7FF)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """A row for each word: its index first, then those of its neighbours; repeats are -1."""
        own = self.index(words)
        out = np.sort(np.stack([self.index(words ^ (1 << b)) for b in range(bits)], axis=1), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        out[out == own[:, None]] = -1
        return np.concatenate([own[:, None], out], axis=1)


GOLAY = Golay()


def fingerprint(text: str) -> int:
    """64-bit SimHash of word shingles, as an unsigned number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        counts += np.unpackbits(hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.uint64)[0])


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [GOLAY.near(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    rows, found = [], []
    for k, (a, b) in enumerate(PAIRS):
        own_a, own_b = near[a][:, :1], near[b][:, :1]
        for left, right, skip in ((own_a, near[b], 0), (near[a], own_b, 1)):
            ok = (left >= 0) & (right >= 0)
            ok[:, :skip] = False  # both kinds have (index, index)
            key = (k << 24) | (left << 12) | right
            r, _ = np.nonzero(ok)
            rows.append(r)
            found.append(key[ok])
    return np.concatenate(rows), np.concatenate(found)


def forest(prints: np.ndarray, ids: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (id, smaller id) that connect what is connected at ``distance`` or fewer differing bits."""
    left, out = np.argsort(ids), []
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            hit = np.bitwise_count(prints[left] ^ prints[queue.pop()]) <= distance
            if hit.any():
                new, left = left[hit], left[~hit]
                out += [(int(ids[i]), int(ids[start])) for i in new]
                queue.extend(new)
    return out


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        prints = np.array([fingerprint(t or "") for t in f["text"]], np.uint64)
        yield pd.DataFrame({"row_id": f["row_id"].astype("Int64"), "fp": prints.view(np.int64)})


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows, found = keys(f["fp"].to_numpy(np.int64).view(np.uint64))
        yield pd.DataFrame({"key": found, "fp": f["fp"].to_numpy()[rows], "rep": f["rep"].to_numpy()[rows]})


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by key and pair of blocks."""

    def of(key, fp, rep):
        out = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
        out = [np.stack([np.maximum(rep[two], rep[two + 1]), np.minimum(rep[two], rep[two + 1])], axis=1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if found := forest(fp[s : s + n], rep[s : s + n]):
                out.append(np.array(found, np.int64))
        both = np.concatenate(out)
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})

    held = None
    for f in frames:
        if f.empty:
            continue
        both = f["key"].to_numpy(np.int64) << 32 | f["lo"].to_numpy(np.int64) << 16 | f["hi"].to_numpy(np.int64)
        now = [both, f["fp"].to_numpy(np.int64).view(np.uint64), f["rep"].to_numpy(np.int64)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
        if last:
            yield of(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None:
        yield of(*held)


def in_blocks(keyed: DataFrame) -> DataFrame:
    """Keyed fingerprints with the blocks lo and hi that meet; both are 0 for keys of one block, and a row of a larger key
    is in one row for each other block."""
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "simhash-large")
    blocks = large.select("key", F.least(F.ceil(F.col("n") / BLOCK), F.lit(1 << 15)).cast("int").alias("blocks"))
    joined = keyed.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_KEYS else blocks, "key", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(block)))
    met = joined.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", F.explode(others))
    return met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "rep")


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: row id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows with a
    null id get the component of their fingerprint's other rows, or null, and link nothing by themselves. Repeated rows
    are repeated in the result; an empty table gives an empty result; columns other than the two named are not read.
    """
    source = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    prints = materialize(source.mapInPandas(_fingerprints, "row_id long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    keyed = materialize(nodes.where("rep is not null").select("fp", "rep").mapInPandas(_keys, "key int, fp long, rep long"), "simhash-keys")
    links = in_blocks(keyed).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(_links, "u long, v long")
    found = connected_components(links, lambda df: materialize(df, "simhash-links"))
    groups = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    joined = join_groups(prints, groups, "fp", "n")
    return joined.select(F.col("row_id").alias(row_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
