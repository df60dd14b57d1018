"""Operator 1: benchmark decontamination over a BM25 inverted index with block-max WAND.

The index holds the benchmark items: for each term its postings (items with BM25 weights, each item's weights scaled
to sum to 1), the largest weight over all items and the largest in each block of BLOCK items. Every passage of a
document is a query: windows of twice the longest item of a length class, starting every such length, so that each
possible place of an item lies whole in a window. All items that score at least THRESHOLD are wanted, so the threshold
is fixed, and the WAND tests can run over all windows of a batch at once:

1. terms so common that together they add at most COMMON to any item are left to the end (they cannot decide alone);
2. a window whose terms' largest weights do not reach the threshold less COMMON is skipped;
3. of the others, blocks whose block maxima do not reach it are skipped;
4. only then are postings read and scored.

Hits are verified: five-word shingles of the item's question (all but its last sentence), or of the whole item where the
question alone was altered, and the words of its answer (the last sentence) have to overlap with the text around the hit.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import materialize

K1, B = 1.2, 0.75
THRESHOLD, COMMON = 0.6, 0.25
#: Items of one block.
BLOCK = 8
#: Words of the longest items of the first length class; each further class doubles it.
CLASS_WORDS = 64
SHINGLE, OVERLAP, ANSWER_OVERLAP = 5, 0.8, 0.5
#: Postings of one part of the index, about: all that the driver and a task hold of it at once. Each part reads the documents again.
PART_POSTINGS = 1_000_000
#: Tokens that are looked at in one step.
STEP_TOKENS = 400_000

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def split_item(text: str) -> tuple[list[str], int]:
    """The words of an item, and how many of them are the question; an item of one sentence has its last words as answer."""
    words = words_of(text)
    parts = [n for n in (len(words_of(p)) for p in SENTENCE.split(text)) if n]
    answer = parts[-1] if len(parts) > 1 else min(len(words), SHINGLE)
    return words, len(words) - answer


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


@dataclass
class Item:
    id: int
    words: list
    question: int

    def verify(self, region: list[str]) -> tuple[float, float, float]:
        """Overlap of the whole item, of its question (shingles), and of its answer (words)."""
        if len(self.words) < SHINGLE:
            n = len(self.words)
            there = float(any(region[i : i + n] == self.words for i in range(len(region) - n + 1)))
            return there, there, there
        there = set(shingles(region))
        own = [s in there for s in shingles(self.words)]
        asked = own[: max(1, self.question - SHINGLE + 1)]
        left = Counter(region)
        answer = self.words[self.question :]
        found = sum(1 for w, n in Counter(answer).items() for k in range(n) if left[w] > k)
        return sum(own) / len(own), sum(asked) / len(asked), found / max(1, len(answer))


class Index:
    """One part of the inverted index, of one length class."""

    def __init__(self, span: int, items: list[Item], postings: dict[str, list[tuple[int, float]]]):
        self.span, self.items = span, items
        self.blocks = -(-len(items) // BLOCK)
        terms = sorted(postings)
        common: set[str] = set()
        added = np.zeros(len(items))
        for t in sorted(terms, key=lambda t: (-len(postings[t]), t)):
            more = added.copy()
            for i, w in postings[t]:
                more[i] += w
            if more.max() > COMMON:
                break
            common.add(t)
            added = more
        self.ids = {t: k for k, t in enumerate(terms)}
        self.slack = float(added.max()) if len(items) else 0.0
        self.bound = np.array([0.0 if t in common else max(w for _, w in postings[t]) for t in terms])
        self.at = np.r_[0, np.cumsum([len(postings[t]) for t in terms])].astype(np.int64)
        flat = [p for t in terms for p in sorted(postings[t])]
        self.item, self.weight = np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat])
        tops = []
        for t in terms:
            best: dict[int, float] = {}
            for i, w in postings[t] if t not in common else ():
                best[i // BLOCK] = max(w, best.get(i // BLOCK, 0.0))
            tops.append(sorted(best.items()))
        self.block_at = np.r_[0, np.cumsum([len(x) for x in tops])].astype(np.int64)
        self.block = np.array([b for x in tops for b, _ in x], np.int64)
        self.block_bound = np.array([w for x in tops for _, w in x])

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(document, first word of a window, item, score) of all windows and items at or over THRESHOLD.

        ``docs`` has the term ids of each document's words, -1 for words that the index does not know.
        """
        if not self.items or not docs:
            return []
        span, least = self.span, THRESHOLD - self.slack - 1e-9
        halves = np.array([-(-len(d) // span) + 1 for d in docs], np.int64)  # the last is empty and parts documents
        first = np.r_[0, np.cumsum(halves)]
        total = int(first[-1])
        half = np.concatenate([np.arange(len(d)) // span + f for d, f in zip(docs, first, strict=False)])
        term = np.concatenate(docs)
        ok = term >= 0
        pairs = np.unique(half[ok] * len(self.ids) + term[ok])
        half, term = pairs // len(self.ids), pairs % len(self.ids)
        deciding = self.bound[term] > 0
        h, t = half[deciding], term[deciding]
        sums = np.bincount(h, weights=self.bound[t], minlength=total + 1)
        window = sums[:-1] + sums[1:] >= least
        used = np.r_[window, False] | np.r_[False, window]
        keep = used[h]
        h, t = h[keep], t[keep]
        if not len(h):
            return []
        n = self.block_at[t + 1] - self.block_at[t]
        place = np.repeat(self.block_at[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        h, bound = np.repeat(h, n), self.block_bound[place]
        # Sums by window and block, where there are any: each half counts for its own window and for the one before it.
        cell = np.r_[h * self.blocks + self.block[place], (h - 1) * self.blocks + self.block[place]]
        ok = np.r_[window[np.minimum(h, total - 1)] & (h < total), (h > 0) & window[np.maximum(h - 1, 0)]]
        cells, which = np.unique(cell[ok], return_inverse=True)
        cells = cells[np.bincount(which, weights=np.r_[bound, bound][ok], minlength=len(cells)) >= least]
        out = []
        start = np.searchsorted(half, np.arange(total + 2))
        live = np.zeros(self.blocks, bool)
        for some in np.split(cells, np.flatnonzero(np.diff(cells // self.blocks)) + 1) if len(cells) else ():
            w = int(some[0] // self.blocks)
            live[:] = False
            live[some % self.blocks] = True
            terms = np.unique(term[start[w] : start[min(w + 2, total + 1)]])
            n = self.at[terms + 1] - self.at[terms]
            place = np.repeat(self.at[terms] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            place = place[live[self.item[place] // BLOCK]]
            score = np.bincount(self.item[place], weights=self.weight[place], minlength=len(self.items))
            doc = int(np.searchsorted(first, w, "right")) - 1
            out += [(doc, int(w - first[doc]) * span, int(i), float(score[i])) for i in np.flatnonzero(score >= THRESHOLD)]
        return out


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for item, text in zip(f["item_id"], f["text"], strict=True):
            words = words_of(text or "")
            rows += [(item, t, n, len(words)) for t, n in Counter(words).items()]
        if rows:
            yield pd.DataFrame(rows, columns=["item_id", "term", "tf", "n_words"])


def build_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[Index]]:
    """The index, in parts of at most about PART_POSTINGS postings (a list of length classes each).

    Document frequencies, mean length and weights are computed over all items by Spark; of items with one id the
    smallest text counts. Null and empty items are in no index.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(item_id).cast("long").alias("item_id")).agg(F.min(text).alias("text"))
    postings = materialize(items.mapInPandas(_tokens, "item_id long, term string, tf long, n_words long"), "bm25-postings")
    sizes = postings.groupBy("item_id").agg(F.max("n_words").alias("n_words"))
    n, mean = sizes.agg(F.count("*"), F.avg("n_words")).first()
    if not n:
        return
    found = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(mean)))
    weighted = postings.join(found, "term").select("item_id", "term", weight.alias("weight"))
    weighted = weighted.join(weighted.groupBy("item_id").agg(F.sum("weight").alias("own")), "item_id")
    parts = -(-postings.count() // PART_POSTINGS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    weighted = materialize(weighted.select("item_id", "term", (F.col("weight") / F.col("own")).alias("weight"), part.alias("part")), "bm25-weights")
    for k in range(parts):
        texts = {r["item_id"]: split_item(r["text"]) for r in items.where(part == k).collect()}
        of_class: dict[int, list[Item]] = defaultdict(list)
        for i in sorted(texts):
            words, question = texts[i]
            if words:
                of_class[CLASS_WORDS << max(0, math.ceil(math.log2(len(words) / CLASS_WORDS)))].append(Item(i, words, question))
        place = {item.id: (span, at) for span, some in of_class.items() for at, item in enumerate(some)}
        lists: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for r in weighted.where(F.col("part") == k).select("item_id", "term", "weight").collect():
            span, at = place[r["item_id"]]
            lists[span][r["term"]].append((at, r["weight"]))
        yield [Index(span, some, lists[span]) for span, some in sorted(of_class.items())]


def search(indexes: list[Index], texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
    """(text number, item id, score, overlap, question overlap, answer overlap) of all verified hits in ``texts``."""
    out: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        batch, size = [], 0

        def flush(batch):
            docs = [np.fromiter(map(index.ids.get, words, [-1] * len(words)), np.int64, len(words)) for _, words in batch]  # noqa: B023
            for doc, start, item, score in index.candidates(docs):  # noqa: B023
                number, words = batch[doc]
                known = index.items[item]  # noqa: B023
                region = words[max(0, start - index.span) : start + 3 * index.span]  # noqa: B023
                whole, question, answer = known.verify(region)
                if max(whole, question) >= OVERLAP and answer >= ANSWER_OVERLAP:
                    new = (score, whole, question, answer)
                    out[number, known.id] = max(out.get((number, known.id), new), new)

        for number, text in enumerate(texts):
            words = words_of(text)
            batch.append((number, words))
            size += len(words)
            if size >= STEP_TOKENS:
                flush(batch)
                batch, size = [], 0
        if batch:
            flush(batch)
    return [(*key, *value) for key, value in out.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: row id, item_id, score, overlap, question_overlap, answer_overlap.

    Null and empty texts match nothing; repeated rows and rows with one id (null ids too) count once, with their best
    hit. An empty benchmark or table gives an empty result; columns other than those named are not read.
    """
    spark = docs.sparkSession
    found: DataFrame | None = None
    source = docs.where(F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    schema = "row_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    for part in build_index(benchmark):
        shared = spark.sparkContext.broadcast(part)  # PART_POSTINGS postings at most, about

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for f in frames:
                hits = search(shared.value, f["text"].tolist())
                if hits:
                    ids = f["row_id"].astype("Int64").iloc[[h[0] for h in hits]].reset_index(drop=True)
                    yield pd.concat([ids, pd.DataFrame([h[1:] for h in hits], columns=["item_id", "score", "overlap", "question_overlap", "answer_overlap"])], axis=1)

        hits = materialize(source.mapInPandas(run, schema), "benchmark-hits")  # before the next part of the index is read
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = spark.createDataFrame([], schema) if found is None else found
    best = found.groupBy("row_id", "item_id").agg(F.max(F.struct("score", "overlap", "question_overlap", "answer_overlap")).alias("best"))
    return best.select(F.col("row_id").alias(row_id), "item_id", "best.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
