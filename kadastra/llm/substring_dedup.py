"""Operator 10: substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text's words; a chunk ends after a word whose hash is the smallest among its
RADIUS neighbours on each side. So cuts depend on a few words around them only, and an insertion shifts nothing else.
Chunks are counted by digest over all documents. Each repeated chunk knows its first document and its place there:

* neighbouring chunks of a document that are neighbours in one first document too make a part; a part of MIN_WORDS words
  or more is a passage of both documents;
* chunks in no such part, in a stretch of repeated chunks that could hold a passage, are asked about by all but their first
  document: the windows of MIN_WORDS words around them and around all their other places are compared by hashes of 96 bits.

So a passage is never put together from chunks that different documents hold, and no chunk is believed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import free_name, materialize
from kadastra.operators.skew import join_groups

#: Repeated passages have at least this many words.
MIN_WORDS = 51
#: Neighbours on each side that the hash at a cut has to undercut, and the longest chunk, in words.
RADIUS, LONGEST = 4, 32
#: The hash sees 2**DOUBLINGS bytes, which are 2**(DOUBLINGS - 1) words at most.
DOUBLINGS = 4
#: Words at the start and the end of a passage in which cuts may differ by what the hash and the neighbours see beyond them.
SLACK = RADIUS + (1 << (DOUBLINGS - 1)), RADIUS
#: Stretches of windows that are broadcast at most (about 40 bytes each); beyond that the texts are shuffled to them.
BROADCAST_PLACES = 1_000_000

GEAR = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the two hashes of stretches of words; the first one makes the digests of chunks.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

ROW = "row_id long, k int"
CHUNK = f"digest long, {ROW}, pack long"
RUN = f"{ROW}, chunks array<struct<digest:bigint,start:bigint,low:bigint,high:bigint,asked:boolean>>, parts array<struct<start:bigint,n_words:bigint,first_id:bigint,first_k:int,first_start:bigint>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def cuts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words that start a chunk, with the number of words at the end; and those of them that the hash alone chose."""
    n = len(words)
    if not n:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    data = GEAR[np.frombuffer(b" ".join(words), np.uint8)]
    for k in range(DOUBLINGS):
        step = 1 << k
        data[step:] = data[step:] + (data[:-step] << np.uint64(step)) if len(data) > step else data[step:]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 2
    mixed = data[ends] * np.uint64(0x9E3779B97F4A7C15)
    low = np.ones(n, bool)
    for k in range(1, RADIUS + 1):
        low[k:] &= mixed[k:] < mixed[:-k]
        low[:-k] &= mixed[:-k] <= mixed[k:]  # of equal ones the first, as in a row of one word
    low[:RADIUS], low[n - RADIUS :] = False, False
    starts = np.r_[0, np.flatnonzero(low) + 1, n]
    if np.diff(starts).max() <= LONGEST:
        return starts, starts
    pieces = []
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        inner = [a]
        while b - inner[-1] > LONGEST:  # rows of repeated words: after the first smallest hash, so that all copies fall into step
            at = inner[-1] + RADIUS
            inner.append(at + int(mixed[at : inner[-1] + LONGEST].argmin()) + 1)
        pieces += inner
    return np.array([*pieces, n]), starts


def window_hashes(words: list[bytes], factor: int) -> np.ndarray:
    """Prefix sums from which hash_of() takes the hash of any stretch of words, alike wherever it stands."""
    n = len(words)
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    up = np.full(n + 1, factor, np.uint64)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    down = np.full(n + 1, pow(factor, -1, 1 << 64), np.uint64)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return np.stack([np.r_[np.zeros(1, np.uint64), np.cumsum(each * down[:-1], dtype=np.uint64)], up])


def hash_of(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((sums[0][b] - sums[0][a]) * sums[1][a]).view(np.int64)


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest, document, and packed: first word, words, and words between the chunk and the next cuts that the hash chose."""

    def out(parts):
        hashes, ids, ks, packs = zip(*parts, strict=True)
        return pd.DataFrame({"digest": np.concatenate(hashes), "row_id": np.concatenate(ids), "k": np.concatenate(ks), "pack": np.concatenate(packs)})

    parts, held = [], 0
    for f in frames:
        for row_id, k, text in zip(f["row_id"], f["k"], f["text"], strict=True):
            words = words_of(text)
            if not words:
                continue
            at, true = cuts(words)
            n = np.diff(at)
            before = at[:-1] - true[np.maximum(np.searchsorted(true, at[:-1], "left") - 1, 0)]
            after = true[np.minimum(np.searchsorted(true, at[1:], "right"), len(true) - 1)] - at[1:]
            pack = (at[:-1] << 24) | (n << 16) | (np.minimum(before, 255) << 8) | np.minimum(after, 255)
            parts.append((hash_of(window_hashes(words, FACTORS[0]), at[:-1], at[1:]), np.full(len(n), row_id, np.int64), np.full(len(n), k, np.int32), pack))
            held += len(n)
            if held > 100_000:
                yield out(parts)
                parts, held = [], 0
    if parts:
        yield out(parts)


def _runs(least: int):
    """Runs of neighbouring repeated chunks that could hold a passage, of a partition sorted by document and pack."""

    def of(f: pd.DataFrame) -> pd.DataFrame:
        ids, k, pack, first, first_k, first_at = (f[c].to_numpy(np.int64) for c in ("row_id", "k", "pack", "first_id", "first_k", "first_pack"))
        twice = np.r_[False, (ids[1:] == ids[:-1]) & (k[1:] == k[:-1]) & (pack[1:] == pack[:-1])]  # repeated rows
        if twice.any():
            f = f[~twice]
            ids, k, pack, first, first_k, first_at = (x[~twice] for x in (ids, k, pack, first, first_k, first_at))
        digest = f["digest"].to_numpy(np.int64)
        start, n, there = pack >> 24, pack >> 16 & 0xFF, first_at >> 24
        new = np.r_[True, (ids[1:] != ids[:-1]) | (k[1:] != k[:-1]) | (start[1:] != start[:-1] + n[:-1])]
        part = new | np.r_[True, (first[1:] != first[:-1]) | (first_k[1:] != first_k[:-1]) | (there[1:] != there[:-1] + n[:-1])]
        own = (first == ids) & (first_k == k)
        size = np.add.reduceat(n, np.flatnonzero(part))
        proven = (size >= least) & ~own[part]
        sure = proven[np.cumsum(part) - 1]
        run_at, part_at = np.flatnonzero(new), np.flatnonzero(part)
        run_end = np.r_[run_at[1:], len(ids)]
        at = np.flatnonzero(new | np.r_[True, sure[1:] != sure[:-1]])  # stretches of proven or of open chunks
        end = np.r_[at[1:], len(ids)]
        room = np.add.reduceat(n, at) + np.where(new[at], pack[at] >> 8 & 0xFF, 0) + np.where(np.r_[new, True][end], pack[end - 1] & 0xFF, 0) + sum(SLACK)
        asked = ~sure & ~own & np.repeat(room >= least, end - at)  # for chunks that a document holds first, the later ones ask
        # A passage that holds chunks of a run ends within the chunks beside it, but for SLACK: its windows lie between these.
        reach_low = np.maximum(start[run_at] - (pack[run_at] >> 8 & 0xFF) - SLACK[0], 0)
        reach_high = start[run_end - 1] + n[run_end - 1] + (pack[run_end - 1] & 0xFF) + SLACK[1]
        able = reach_high - reach_low >= least
        low = np.maximum(np.repeat(reach_low, run_end - run_at), start + n - least)
        high = np.minimum(np.repeat(reach_high, run_end - run_at) - least, start)
        rows = []
        for a, b, ok in zip(run_at.tolist(), run_end.tolist(), able.tolist(), strict=True):
            if ok:
                p, q = np.searchsorted(part_at, [a, b])
                parts = [(int(start[part_at[i]]), int(size[i]), int(first[part_at[i]]), int(first_k[part_at[i]]), int(there[part_at[i]])) for i in range(p, q) if proven[i]]
                chunks = list(zip(digest[a:b].tolist(), start[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist(), asked[a:b].tolist(), strict=True))
                rows.append((ids[a], k[a], chunks, parts))
        return pd.DataFrame(rows, columns=["row_id", "k", "chunks", "parts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            if f.empty:
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            same = (f["row_id"] == f["row_id"].iloc[-1]) & (f["k"] == f["k"].iloc[-1])  # the last document may go on in the next batch
            if not same.all():
                yield of(f[~same])
            held = f[same].reset_index(drop=True)
        if held is not None:
            yield of(held)

    return run


def _windows(least: int):
    """Hashes of all windows of ``least`` words that start at ``places`` (from low to high)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row_id, k, text, places in zip(f["row_id"], f["k"], f["text"], f["places"], strict=True):
                words = words_of(text)
                wanted = np.zeros(max(len(words) - least + 1, 0), bool)
                for place in places:
                    wanted[place["low"] : place["high"] + 1] = True
                at = np.flatnonzero(wanted)
                if len(at):
                    one, two = (hash_of(window_hashes(words, x), at, at + least) for x in FACTORS)
                    out.append(pd.DataFrame({"hash": one, "check": (two >> 32).astype(np.int32), "row_id": np.int64(row_id), "k": np.int32(k), "start": at.astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _spans(least: int):
    """Stretches of one document and first document joined where no window of ``least`` words is new, of a partition sorted by
    these and the first word."""
    keys = ["row_id", "k", "first_id", "first_k"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None
        for f in frames:
            out = []
            for *key, start, n in f[[*keys, "start", "n_words"]].itertuples(index=False):
                if held is not None and key == held[0] and (start + n <= held[2] or start + least <= held[2] + 1):
                    held[2] = max(held[2], start + n)
                    continue
                if held is not None:
                    out.append((*held[0], held[1], held[2] - held[1]))
                held = [key, start, start + n]
            if out:
                yield pd.DataFrame(out, columns=[*keys, "start", "n_words"])
        if held is not None:
            yield pd.DataFrame([(*held[0], held[1], held[2] - held[1])], columns=[*keys, "start", "n_words"])

    return run


def keys_of(text: str, row_id: str) -> tuple[Column, Column]:
    """What tells documents apart: the id, or a hash of the text where it is null, and 31 bits of another hash, negative where
    the id is null."""
    other = F.xxhash64(F.lit("other"), F.col(text)).bitwiseAND(F.lit((1 << 31) - 1))
    return F.coalesce(F.col(row_id).cast("long"), F.xxhash64(text)), F.when(F.col(row_id).isNull(), -1 - other).otherwise(other).cast("int")


def joined(stretches: Column) -> Column:
    """Sorted stretches (low, high) of numbers, those that touch made one."""
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["low"].alias("low"), F.greatest(last(acc)["high"], x["high"]).alias("high"))))
    return F.aggregate(F.slice(stretches, 2, F.size(stretches)), F.slice(stretches, 1, 1), lambda acc, x: F.when(x["low"] <= last(acc)["high"] + 1, grow(acc, x)).otherwise(F.concat(acc, F.array(x))))


def documents_of(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """row_id, k (see keys_of) and text of all rows that have a text."""
    own, k = keys_of(text, row_id)
    return docs.where(F.col(text).isNotNull()).select(own.alias("row_id"), k.alias("k"), F.col(text).alias("text"))


def passages(docs: DataFrame, text: str = "text", row_id: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """What repeats() tells, by the documents' inner keys: row_id, k, start, n_words, first_id, first_k."""
    source = documents_of(docs, text, row_id)
    chunks = materialize(source.mapInPandas(_chunks, CHUNK), "chunks")
    counts = chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    found = join_groups(chunks, materialize(counts, "repeated-chunks"), "digest", "n")
    found = materialize(found, "repeated-places")
    here = F.struct("row_id", "k", "pack")
    groups = found.groupBy("digest").agg(F.min(here).alias("first"), F.max(F.struct("row_id", "k")).alias("last"), F.max("n").alias("n"))
    groups = groups.where("first.row_id < last.row_id or first.k < last.k").select("digest", "n", F.col("first.row_id").alias("first_id"), F.col("first.k").alias("first_k"), F.col("first.pack").alias("first_pack"))
    placed = join_groups(found.drop("n"), materialize(groups, "first-places"), "digest", "n").drop("n")
    runs = materialize(placed.repartition("row_id", "k").sortWithinPartitions("row_id", "k", "pack").mapInPandas(_runs(least), RUN), "repeated-runs")

    parts = runs.select("row_id", "k", F.explode("parts").alias("p")).select("row_id", "k", "p.*")
    later = parts.select("row_id", "k", "start", "n_words", "first_id", "first_k")
    earlier = parts.select(F.col("first_id").alias("row_id"), F.col("first_k").alias("k"), F.col("first_start").alias("start"), "n_words", "first_id", "first_k").distinct()

    places = runs.select("row_id", "k", F.explode("chunks").alias("c")).select("row_id", "k", "c.*")
    # A window of both documents begins as far from their common chunk in either: as far as those that ask allow.
    off = lambda c: F.when(F.col("asked"), F.col(c) - F.col("start"))
    asked = places.where("low <= high").groupBy("digest").agg(F.count("*").alias("n"), F.min(off("low")).alias("from"), F.max(off("high")).alias("to")).where("n > 1 and from is not null")
    places = join_groups(places.drop("asked"), materialize(asked, "asked-chunks"), "digest", "n").select("row_id", "k", F.greatest("low", F.col("start") + F.col("from")).alias("low"), F.least("high", F.col("start") + F.col("to")).alias("high"))
    places = materialize(places.where("low <= high").groupBy("row_id", "k").agg(joined(F.array_sort(F.collect_set(F.struct("low", "high")))).alias("places")), "asked-places")
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    texts = source.join(F.broadcast(places) if few else places, ["row_id", "k"])
    windows = materialize(texts.mapInPandas(_windows(least), f"hash long, check int, {ROW}, start int"), "asked-windows")
    who = F.struct("row_id", "k")
    twice = windows.groupBy("hash", "check").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.count("*").alias("n")).where("lo < hi")
    twice = twice.select("hash", F.col("check").alias("of_check"), F.col("lo.row_id").alias("first_id"), F.col("lo.k").alias("first_k"), "n")
    proven = join_groups(windows, materialize(twice, "repeated-windows"), "hash", "n").where("check = of_check").select("row_id", "k", F.col("start").cast("long").alias("start"), F.lit(least).cast("long").alias("n_words"), "first_id", "first_k")

    both = later.unionByName(earlier).unionByName(proven)
    return both.repartition("row_id", "k", "first_id").sortWithinPartitions("row_id", "k", "first_id", "first_k", "start", "n_words").mapInPandas(_spans(least), f"{ROW}, first_id long, first_k int, start long, n_words long")


def repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``least`` words that two or more documents share: row id, start_word, n_words, first_id, kept.

    Every stretch of ``least`` words of a passage stands in the first document too, and first_id is its id: the smallest of
    those that hold the passage; kept says that it is the row's own document. Passages of a row with different first
    documents are rows of their own, and may overlap. start_word and n_words tell the chunks or windows that prove the
    passage; its ends may lie some words further out (up to a chunk that is cut otherwise in the first document, and to stretches
    of under MIN_WORDS words, SLACK included, beside a passage that is proven without them). Words are what ASCII white space separates, taken as they are.

    Rows with one id and different texts are different documents, and so are rows without an id (in the result the id and
    first_id are null; they come in the order of a hash). Repeated rows count as one document, and repetition within a
    document does not count. Null texts hold nothing. An empty table gives an empty result; other columns are not read.
    """
    named = lambda i, k, name: F.when(F.col(k) >= 0, F.col(i)).alias(name)
    kept = (F.col("first_id") == F.col("row_id")) & (F.col("first_k") == F.col("k"))
    return passages(docs, text, row_id, least).select(named("row_id", "k", row_id), F.col("start").alias("start_word"), "n_words", named("first_id", "first_k", "first_id"), kept.alias("kept"))


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the passages cut out that an earlier document holds; documents without any are left as they are."""
    own_id, own_k, cut = (free_name(docs, c) for c in ("row_of_cut", "k_of_cut", "cuts"))
    gone = passages(docs, text, row_id, least).where("first_id <> row_id or first_k <> k")
    gone = gone.groupBy(F.col("row_id").alias(own_id), F.col("k").alias(own_k)).agg(F.collect_list(F.struct("start", "n_words")).alias(cut))
    key, k = keys_of(text, row_id)
    marked = docs.withColumns({own_id: key, own_k: k}).join(gone, [own_id, own_k], "left").drop(own_id, own_k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, spans in zip(f[text], f[cut], strict=True):
                if spans is not None and len(spans):
                    words = words_of(t)
                    left = np.ones(len(words), bool)
                    for s in spans:
                        left[s["start"] : s["start"] + s["n_words"]] = False
                    t = b" ".join(words[i] for i in np.flatnonzero(left)).decode("utf-8", "surrogatepass")
                out.append(t)
            yield f.drop(columns=cut).assign(**{text: out})

    return marked.mapInPandas(run, docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return repeats(table(spark, sf_dir, "documents"))
