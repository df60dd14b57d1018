"""Near copies of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.

Operator 9 finds candidates: texts whose SimHash fingerprints links of at most simhash.DISTANCE bits connect, met by Golay-code
keys. Most near copies at similarity 0.8 are further apart than that, so MinHash bands add candidates: a pair at similarity 0.8
shares none of BANDS keys with a chance of (1 - 0.8**ROWS)**BANDS, 5e-6, and less above. What shares a component of
fingerprints or a band's key, however indirectly, is a cluster; a pair is decided within its cluster by exact Jaccard similarity
of whole shingle sets. Clusters too large for a task are dealt to blocks, and each two blocks meet. Equal sets are one node
from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.llm import simhash
from kadastra.llm.common import free_name, materialize
from kadastra.operators.graph import connected_components
from kadastra.operators.hashing import row_hash
from kadastra.operators.skew import join_groups

SHINGLE, SEED, SIMILAR = 5, 42, 0.8
ROWS, BANDS = 6, 40
#: Nodes and shingles of a block, about.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20
#: Nodes that are broadcast at most.
BROADCAST_NODES = 1_000_000

FACTORS = np.random.default_rng(17).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of the MinHash signature; none for an empty set."""
    if not len(shingles):
        return []
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * FACTORS).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(_node(s), len(s), band_keys(s)) for s in (shingle_set(t or "") for t in f.pop("text"))]  # one set at a time
        nodes, sizes, bands = zip(*rows, strict=True) if rows else ((), (), ())
        yield f.assign(node=list(nodes), n_shingles=list(sizes), bands=list(bands))


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(shingles=[shingle_set(t or "").tobytes() for t in f.pop("text")])


def forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected at SIMILAR; each new node is compared with all that are not yet reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    _, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.repeat(np.arange(len(starts)), counts)
    own = np.split(rank, np.cumsum(sizes)[:-1])
    left, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            i = queue.pop()
            if not left.any():
                return out
            shared = own[i][counts[own[i]] > 1]
            if not len(shared):
                continue
            n = counts[shared]
            at = np.repeat(starts[shared] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(left & (both * (1 + SIMILAR) >= SIMILAR * (sizes + sizes[i]) - 1e-9))
            left[hit] = False
            out += [(nodes[j], nodes[i]) for j in hit.tolist()]
            queue += hit.tolist()
    return out


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by cluster and pair of blocks."""
    now, nodes, sets = None, [], []

    def out():
        return pd.DataFrame(forest(nodes, sets) if len(sets) > 1 else [], columns=["u", "v"], dtype="int64")

    for f in frames:
        for cluster, lo, hi, node, shingles in zip(f["cluster"], f["lo"], f["hi"], f["node"], f["shingles"], strict=True):
            if (cluster, lo, hi) != now:
                yield out()
                now, nodes, sets = (cluster, lo, hi), [], []
            nodes.append(int(node))
            sets.append(np.frombuffer(shingles, np.uint64))
    yield out()


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns; rows that agree in both are equal."""
    return [row_hash(docs, salt) for salt in ("first", "second")]


def pick_rows(docs: DataFrame, keys: DataFrame, names: tuple[str, str] = ("k1_of_stage", "k2_of_stage")) -> DataFrame:
    """Rows of ``docs`` whose keys (row_key, in the columns ``names``) are in ``keys``, with the other columns of ``keys``; broadcast if these are few."""
    keys = keys.withColumnsRenamed({"k1_of_stage": names[0], "k2_of_stage": names[1]})
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_NODES else keys, list(names))


def by_fingerprints(source: DataFrame, sketches: DataFrame) -> DataFrame:
    """Node and key, which nodes share that have texts in one component of operator 9. Equal texts count once."""
    components = simhash.near_duplicates(source, row_id="text_key").select("text_key", F.col("component_id").alias("key")).distinct()
    return sketches.select("node", "text_key").distinct().join(components, "text_key").select("node", "key")


def by_bands(sketches: DataFrame) -> DataFrame:
    """Node and key for each band of its signature."""
    return sketches.select("node", F.explode("bands").alias("key"))


def one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, of these that with the smallest key of its values.

    Links are pairs of similarity SIMILAR or more, groups are what they connect. A row with a null id stays if no other
    row of its group has an id; nulls and texts without words are one group. Columns are those of ``docs``.
    """
    columns = docs.columns
    k1, k2 = row_key(docs)
    names = free_name(docs, "k1_of_stage"), free_name(docs, "k2_of_stage")
    keyed = docs.withColumns(dict(zip(names, (k1, k2), strict=True)))
    source = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"), k1.alias("k1_of_stage"), k2.alias("k2_of_stage"))
    sketches = materialize(source.mapInPandas(_sketches, "row_id long, text_key long, k1_of_stage long, k2_of_stage long, node long, n_shingles long, bands array<long>"), "near-sketches")
    best = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "k1_of_stage", "k2_of_stage")).alias("best")
    nodes = materialize(sketches.groupBy("node").agg(best, F.max("n_shingles").alias("n_shingles")), "near-nodes")

    keys = by_bands(sketches).unionByName(materialize(by_fingerprints(source, sketches), "near-components"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    stars = join_groups(keys, materialize(shared, "near-keys"), "key", "n").where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct()
    clusters = materialize(connected_components(stars, lambda df: materialize(df, "near-clusters")), "near-clustered").withColumnRenamed("component", "cluster")

    members = materialize(nodes.join(clusters, "node").select("node", "cluster", "n_shingles", "best.k1_of_stage", "best.k2_of_stage"), "near-members")
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    size = size.select("cluster", "n", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = join_groups(members, size, "cluster", "n").select("node", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "k1_of_stage", "k2_of_stage")
    sets = pick_rows(source.drop("row_id", "text_key"), dealt).drop("k1_of_stage", "k2_of_stage").dropDuplicates(["node"])
    sets = materialize(sets.select("node", "cluster", "blocks", "block", "text").mapInPandas(_sets, "node long, cluster long, blocks int, block int, shingles binary"), "near-sets")
    others = F.when(F.col("blocks") == 1, F.array(F.col("block"))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.col("block"))))
    met = sets.withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "shingles")
    links = met.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInPandas(_links, "u long, v long")
    groups = connected_components(links, lambda df: materialize(df, "near-links"))

    found = nodes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    rows = sketches.groupBy("k1_of_stage", "k2_of_stage").agg((F.count("*") > 1).alias("repeated"))
    marked = rows.join(found.select("best.k1_of_stage", "best.k2_of_stage", F.lit(True).alias("kept")), ["k1_of_stage", "k2_of_stage"], "left")
    apart = materialize(marked.where("repeated or kept is null"), "near-apart")  # rows that go, and kept ones that are repeated
    gone = apart.select(F.col("k1_of_stage").alias(names[0]), F.col("k2_of_stage").alias(names[1]))
    once = keyed.join(F.broadcast(gone) if apart.count() <= BROADCAST_NODES else gone, list(names), "left_anti")
    one = pick_rows(keyed, apart.where("kept").drop("repeated", "kept"), names).dropDuplicates(list(names))  # only these are shuffled whole
    return once.select(*columns).unionByName(one.select(*columns))
