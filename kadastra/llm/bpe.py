"""Operator 12: encoding and decoding by byte-pair merges, with an index of pairs over the words of a chunk.

A text is cut at the vocabulary's special tokens, normalised and split into words as the tokenizer's file says (each stretch
between spaces once for all its occurrences). The different words of a chunk of documents are encoded together: an index maps each pair of symbols that has a merge rank to all its
positions. The ranks that are active are applied in ascending order; each merge puts the pairs that it makes into the index,
and the pairs that it ends are recognised by their symbols when their rank's turn comes. The positions of a rank are merged all
at once while ranks have many, and one by one after that. A word's ids then serve all its
occurrences in the chunk.

The order by rank over the whole chunk is that of each word for itself, since a merge makes pairs of higher ranks only; a
vocabulary in which that does not hold is refused.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import free_name, small_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Characters of text whose words are encoded together, about; one longer text is a chunk of its own.
CHUNK = 4_000_000
#: What the pre-tokenizer of this kind of vocabulary keeps (a fixed value, as in the file).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Positions of a rank, on the average of late ones, from which all of a rank are merged at once.
AT_ONCE = 30


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Merges, symbols and special tokens of a tokenizer file of the kind WordLevel bytes with word ends."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or split != WORDS or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        named = {i: t for t, i in (ids | self.special).items()}
        self.tokens = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())
        names = byte_names()
        self.inner = np.array([ids[x] for x in names], np.int64)
        self.last = np.array([ids[x + WORD_END] for x in names], np.int64)
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        made = {c: r for r, (_, _, c) in enumerate(merges)}
        if len(made) < len(merges) or any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(merges) for x in (a, b)):
            raise ValueError("a merge makes a pair of a lower rank")
        self.bits = max(named).bit_length()
        self.rank = {a << self.bits | b: r for r, (a, b, _) in enumerate(merges)}
        self.merges = merges
        pairs = np.array(list(self.rank), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], order

    def split(self, stretches: list[str]) -> Iterator[list[str]]:
        """Words of each stretch of text, without special tokens and line feeds in it."""
        normal = unicodedata.normalize("NFC", "\n".join(stretches)).replace("Σ", "σ").lower()  # each character for itself
        return ([x] if x.isalpha() else self.words.findall(x) for x in normal.split("\n"))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, where each word begins, and the end)."""
        raw = [w.encode() for w in words]
        starts = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = starts[1:] - 1
        symbols[ends] = self.last[data[ends]]
        joined = np.ones(len(symbols), bool)  # with the symbol after it
        joined[ends] = False

        n = len(symbols)
        right = np.where(joined, np.arange(1, n + 1), -1)
        left = np.r_[-1, np.where(joined, np.arange(n), -1)[:-1]] if n else np.zeros(0, np.int64)
        at = np.flatnonzero(joined)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._enter(symbols[at] << self.bits | symbols[at + 1], at, index, active)
        self._merge_at_once(symbols, right, left, index, active)
        listed = {r: np.concatenate(parts).tolist() for r, parts in index.items()}
        symbols = np.array(self._merge(symbols.tolist(), right.tolist(), left.tolist(), listed, active), np.int64)
        kept = symbols >= 0
        return symbols[kept].astype(np.int32), np.r_[0, np.cumsum(kept)][starts]

    def _enter(self, pairs: np.ndarray, at: np.ndarray, index: dict[int, list[np.ndarray]], active: list[int]) -> None:
        """Put the positions of pairs that have a rank into the index."""
        where = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[where] == pairs
        at, ranks = at[known], self.pair_ranks[where[known]]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        bounds = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(at[lo:hi])

    def _merge_at_once(self, symbols: np.ndarray, right: np.ndarray, left: np.ndarray, index: dict[int, list[np.ndarray]], active: list[int]) -> None:
        """The merges of the lowest active ranks, each rank's all at once, until ranks have few positions. Changes its arguments."""
        bits, size = self.bits, float(len(symbols))
        while active and size >= AT_ONCE:
            r = heapq.heappop(active)
            a, b, made = self.merges[r]
            p = index.pop(r)
            p = np.unique(np.concatenate(p)) if len(p) > 1 else p[0]
            size = 0.9 * min(size, 10 * AT_ONCE) + 0.1 * len(p)
            q = right[p]
            ok = (symbols[p] == a) & (q >= 0) & (symbols[q] == b)  # others were ended by a merge before
            p, q = p[ok], q[ok]
            if a == b:  # of overlapping pairs the first, then every second one
                taken, end = np.ones(len(p), bool), -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    taken[i], end = x != end, -1 if x == end else y
                p, q = p[taken], q[taken]
            symbols[p], symbols[q] = made, -1
            right[p] = after = right[q]
            has = after >= 0
            after, first = after[has], p[has]
            left[after] = first
            before = left[p]
            before = before[before >= 0]
            new = np.concatenate([made << bits | symbols[after], symbols[before] << bits | made])
            self._enter(new, np.concatenate([first, before]), index, active)

    def _merge(self, symbols: list[int], right: list[int], left: list[int], index: dict[int, list[int]], active: list[int]) -> list[int]:
        """Symbols after all other merges; -1 where a symbol went into the one before it."""
        rank, bits = self.rank, self.bits
        while active:
            r = heapq.heappop(active)
            a, b, made = self.merges[r]
            for p in sorted(index.pop(r)):
                q = right[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:  # ended by a merge before
                    continue
                symbols[p], symbols[q] = made, -1
                after, before = right[q], left[p]
                right[p] = after
                if after >= 0:
                    left[after] = p
                    new = rank.get(made << bits | symbols[after])
                    if new is not None:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(active, new)
                        index[new].append(p)
                if before >= 0:
                    new = rank.get(symbols[before] << bits | made)
                    if new is not None:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(active, new)
                        index[new].append(before)
        return symbols

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins, and the end).

        No word holds a space or a line feed, so stretches between these are split and encoded once for all their occurrences."""
        stretches, words = _Numbers(), _Numbers()
        of_text = []
        for t in texts:
            parts = self.cut.split(t) if self.cut else [t]
            if len(parts) == 1:
                numbers = list(map(stretches.__getitem__, t.replace("\n", " ").split(" ")))
            else:
                numbers = []
                for i, part in enumerate(parts):
                    numbers += [stretches[part,]] if i % 2 else map(stretches.__getitem__, part.replace("\n", " ").split(" "))
            of_text.append(np.array(numbers, np.int64))
        special = {t: -1 - k for k, t in enumerate(self.special)}
        flat, sizes = [], []
        for x, found in zip(stretches, self.split(["" if isinstance(x, tuple) else x for x in stretches]), strict=bool(stretches)):
            now = [special[x[0]]] if isinstance(x, tuple) else map(words.__getitem__, found)
            before = len(flat)
            flat += now
            sizes.append(len(flat) - before)
        flat, bounds = np.array(flat, np.int64), np.cumsum([0, *sizes])
        ids, starts = self.encode(list(words))
        n = len(starts) - 1  # special tokens stand behind the words
        ids, starts = np.r_[ids, np.array(list(self.special.values()), np.int32)], np.r_[starts, starts[-1] + 1 + np.arange(len(special))]
        ids, starts = _taken(ids, starts, np.where(flat < 0, n - 1 - flat, flat), bounds)
        return _taken(ids, starts, *_joined(of_text))

    def decode(self, ids: pa.ListArray, skip_special: bool = False) -> pa.Array:
        """Tokens joined by a space (the file names no decoder); null counts as no ids."""
        ids = pc.fill_null(ids, []) if ids.null_count else ids
        if skip_special:
            kept = pc.invert(pc.is_in(ids.flatten(), pa.array(list(self.special.values()), pa.int32())))
            upto = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False))]
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            ids = pa.ListArray.from_arrays(pa.array(upto[offsets], pa.int32()), ids.flatten().filter(kept))
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.tokens.take(ids.flatten())), " ")


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after the other, and their bounds."""
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64), np.r_[0, np.cumsum([len(a) for a in arrays], dtype=np.int64)]


def _taken(values: np.ndarray, starts: np.ndarray, which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of ragged rows (values, starts), one after the other, and where each group of them (bounds) begins and ends."""
    sizes = (starts[1:] - starts[:-1])[which]
    upto = np.r_[0, np.cumsum(sizes)]
    at = np.arange(upto[-1]) + np.repeat(starts[:-1][which] - upto[:-1], sizes)
    return values[at], upto[bounds]


@lru_cache(maxsize=2)
def _vocabulary(raw: str) -> Vocabulary:
    return Vocabulary(raw)


def read_vocabulary(path: str | None = None) -> str:
    """Text of a tokenizer file: ``path``, or the public one of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", row_id: str = "doc_id", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Row id and ``into``, the ids (array<int>) of each whole text, without special tokens around it; those in a text are found.
    With ``decoded`` a column of that name has the text that these ids decode to, as ``decode`` gives it.

    A null text counts as empty and has no ids. Rows are encoded for themselves, so rows without an id and repeated ones are
    returned as they are; an empty table gives an empty result; columns other than the two named are not read. A text of many
    megabytes is a chunk of its own, whose different words alone are held. The vocabulary (a few megabytes, whatever the
    table) is broadcast. Characters that Unicode has only had since version 16 may be split in another way than by the library.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        for batch in batches:
            for lo, hi in _chunks(pc.utf8_length(batch.column(1)).to_pylist()):
                rows = batch.slice(lo, hi - lo)
                ids, starts = known.encode_texts(rows.column(1).to_pylist())
                coded = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), coded, *([known.decode(coded)] if decoded else [])], names=["row_id", into, *([decoded] if decoded else [])])

    source = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = source.mapInArrow(run, f"row_id {source.schema['row_id'].dataType.simpleString()}, `{into}` array<int>" + (f", `{decoded}` string" if decoded else ""))
    return found.withColumnRenamed("row_id", row_id)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded", skip_special: bool = False) -> DataFrame:
    """All columns of ``encoded`` and ``into``, the text of its ids; null ids give an empty text, ids that the vocabulary lacks raise.

    A column that has the name ``into`` already makes it take the next free one (a low line after it)."""
    shared, into = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)), free_name(encoded, into)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared.value)
        for batch in batches:
            for lo, hi in _chunks(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()):
                rows = batch.slice(lo, hi - lo)
                yield rows.append_column(into, known.decode(rows.column(at), skip_special))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{into}` string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = encode(table(spark, sf_dir, "documents"), decoded="decoded")  # in one worker: two would hold the vocabulary twice
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
