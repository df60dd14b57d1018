"""Operator 6: toxicity by a learned lexicon, matched with Levenshtein automata and scored in context windows.

Labelled rows teach the lexicon: whole words and word beginnings (stems) that toxic documents hold far more often
than chance, with log-odds as weights. The lexicon is a trie. A word is looked up by running its Levenshtein automaton of
degree one over the trie, state by state; stems accept words that go on. Misspelt words count less than exact ones, and not at all if a clean labelled document has them.
Around each hit a window of words is looked at: further hits raise its score, quotation marks on both sides lower it.
Ridge regression on the document's scores, then isotonic calibration, give a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import by_hash, materialize, sample_rate
from kadastra.llm.models import calibrated, isotonic, normal_equations, ridge

#: Labelled rows that the model is fitted on, at most (about); chosen by a hash of their ids.
MAX_FIT = 20_000
#: Lengths of word beginnings that may become stems.
STEM = range(3, 9)
#: Whole words at least this long are also found when misspelt.
FUZZY_LENGTH = 5
#: Words on each side of a hit.
WINDOW = 8
THRESHOLD = 0.3
#: Words whose lookup a worker remembers.
MEMORY = 50_000

WORDS = re.compile(r"\w+")
OPEN, CLOSE = re.compile(r"""["“„«]|(?<!\w)['‘]"""), re.compile(r"""["”“»]|['’](?!\w)""")


def shortenings(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


@dataclass
class Trie:
    """Terms with weights; a stem's term also accepts words that go on after it."""

    root: dict = field(default_factory=dict)
    shortened: set = field(default_factory=set)  # long whole words, and what is left of them without one letter

    def add(self, term: str, weight: float, stem: bool) -> None:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        kind = "stem" if stem else "word"
        node[kind] = max(weight, node.get(kind, 0.0))
        if not stem and len(term) >= FUZZY_LENGTH:
            node["long"] = node[kind]
            self.shortened.update((term, *shortenings(term)))

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "stem" in node:
                best = max(best, node["stem"])
        return max(best, node.get("word", 0.0))

    def near(self, word: str) -> float:
        """Largest weight of a long whole word at one edit from ``word``, an exchange of two neighbouring letters included.

        States of the automaton are (letters read, edits made). Without edits it follows one path of the trie; from
        each node there, one edit leads to states that have to follow the rest of the word letter by letter.
        """
        n = len(word)
        if n < FUZZY_LENGTH - 1 or (word not in self.shortened and self.shortened.isdisjoint(shortenings(word))):
            return 0.0  # two words at one edit are equal, or without a letter of one, or of both

        def rest(node: dict, at: int) -> float:
            for c in word[at:]:
                node = node.get(c)
                if node is None:
                    return 0.0
            return node.get("long", 0.0)

        best, node = 0.0, self.root
        for i in range(n + 1):
            if i < n:
                best = max(best, rest(node, i + 1))  # a letter too many
            if i + 1 < n and word[i] != word[i + 1]:  # two exchanged
                other = node.get(word[i + 1])
                if other is not None and (other := other.get(word[i])) is not None:
                    best = max(best, rest(other, i + 2))
            for c, child in node.items():
                if len(c) == 1:
                    best = max(best, rest(child, i))  # one missing
                    if i < n and c != word[i]:
                        best = max(best, rest(child, i + 1))  # another one
            node = node.get(word[i]) if i < n else None
            if node is None:
                break
        return best


@dataclass
class Lexicon:
    trie: Trie
    clean: frozenset  # misspellings that clean labelled documents hold

    def __post_init__(self):
        self.seen: set = set()
        self.hits: dict = {}  # word: (weight, exact)

    def learn(self, words: set) -> None:
        if len(self.seen) > MEMORY:
            self.seen, self.hits = set(), {}
        for w in words - self.seen:
            if weight := self.trie.exact(w):
                self.hits[w] = (weight, True)
            elif w not in self.clean and (weight := self.trie.near(w)):
                self.hits[w] = (weight / 2, False)
        self.seen |= words

    def find(self, text: str) -> tuple[int, list[tuple[int, float, bool, bool]]]:
        """Number of words, and of each hit: number of the word, weight, exact, quoted."""
        low = text.lower()
        words = WORDS.findall(low)
        own = set(words)
        self.learn(own)
        if own.isdisjoint(self.hits):
            return len(words), []
        out = []
        spans = [m.span() for m in WORDS.finditer(low)]
        for i, w in enumerate(words):
            if w in self.hits:
                before = low[spans[max(0, i - WINDOW)][0] : spans[i][0]]
                after = low[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
                quoted = bool(OPEN.search(before)) and bool(CLOSE.search(after))
                out.append((i, *self.hits[w], quoted))
        return len(words), out


FEATURES = 10


def features(lexicon: Lexicon, text: str) -> list[float]:
    n, hits = lexicon.find(text)
    if not hits:
        return [1.0, math.log1p(n)] + [0.0] * (FEATURES - 2)
    exact = [h for h in hits if h[2]]
    score, top, j, k = 0.0, 0.0, 0, 0
    at = [h[0] for h in hits]
    for i, (place, weight, _, quoted) in enumerate(hits):
        while at[j] < place - WINDOW:
            j += 1
        k = max(k, i)
        while k + 1 < len(at) and at[k + 1] <= place + WINDOW:
            k += 1
        own = weight * (1 + 0.5 * min(k - j, 4)) * (0.3 if quoted else 1.0)
        score, top = score + own, max(top, own)
    return [1.0, math.log1p(n), float(bool(exact)), math.log1p(sum(h[1] for h in exact)), math.log1p(len(hits)), 100 * len(hits) / n, math.log1p(sum(h[1] for h in hits if not h[2])), math.log1p(sum(h[3] for h in hits)), math.log1p(score), top]


def remainder(row_id: Column, divisor: int) -> Column:
    return F.crc32(row_id.cast("string").cast("binary")) % divisor


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by term and label; terms are words, stems end with an asterisk."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out(step: int = 50_000) -> Iterator[pd.DataFrame]:
        names = list(counts[0] | counts[1])
        for at in range(0, len(names), step):
            some = names[at : at + step]
            yield pd.DataFrame({"term": some, "clean": [counts[0][t] for t in some], "toxic": [counts[1][t] for t in some]})
        for c in counts:
            c.clear()

    for f in frames:
        for text, label in zip(f["text"], f["label"], strict=True):
            words = set(WORDS.findall((text or "").lower()))
            counts[int(label)].update(words | {w[:k] + "*" for w in words for k in STEM if len(w) > k})
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield from out()
    yield from out()


def learn_terms(rows: DataFrame) -> tuple[list[tuple[str, float]], int, int]:
    """The lexicon of labelled (text, label) rows: terms with weights. Chosen are terms with over twice the share
    of toxic documents that chance would give a term of their count, among as many terms as were tried. The rows are a
    bounded sample, which bounds the terms too."""
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = by_label.get(1, 0), by_label.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    counts = materialize(rows.mapInPandas(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-terms")
    tried, rate = counts.count(), toxic / (toxic + clean)
    n, share = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    rest = F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = n * (share * F.log(share / rate) + rest)  # exponent of the chance of such a count
    found = counts.where((F.col("toxic") >= 3) & (share > max(0.4, min(0.9, 2 * rate))) & (surprise > math.log(tried))).select("term", "toxic", "clean", surprise.alias("surprise"))
    best = sorted(found.collect(), key=lambda r: (-len(r["term"].rstrip("*")), r["term"]))
    chosen: dict[str, tuple[float, int, int]] = {}
    for r in best:  # whole words and long stems first; a shorter stem has to be worth it without those
        stem = r["term"].rstrip("*") if r["term"].endswith("*") else None
        inner = [v for t, v in chosen.items() if stem is not None and t.startswith(stem)]
        n_toxic, n_clean = r["toxic"] - sum(v[1] for v in inner), r["clean"] - sum(v[2] for v in inner)
        if n_toxic >= 3 and (n_toxic + 0.5) / (n_toxic + max(n_clean, 0) + 1) > 0.4:
            chosen[r["term"]] = (math.log((n_toxic + 0.5) / (max(n_clean, 0) + 0.5)) - math.log(toxic / clean), n_toxic, max(n_clean, 0))
    return sorted((t, v[0]) for t, v in chosen.items()), toxic, clean


def _lexicon(terms: list[tuple[str, float]], clean: frozenset = frozenset()) -> Lexicon:
    trie = Trie()
    for term, weight in terms:
        trie.add(term.rstrip("*"), weight, term.endswith("*"))
    return Lexicon(trie, clean)


def clean_misspellings(rows: DataFrame, terms: list[tuple[str, float]]) -> frozenset:
    """Words at one edit from the lexicon that clean documents of the labelled sample hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, found = _lexicon(terms), Counter()
        for f in frames:
            for text in f["text"]:
                words = set(WORDS.findall((text or "").lower()))
                lexicon.learn(words)
                found.update(w for w in words & lexicon.hits.keys() if not lexicon.hits[w][1])
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    got = rows.where("label = 0").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in got.select("word").collect())


def lexicon_of(rows: DataFrame) -> tuple[list[tuple[str, float]], frozenset]:
    terms, _, _ = learn_terms(rows)
    return terms, clean_misspellings(rows, terms) if terms else frozenset()


@dataclass
class Model:
    terms: list
    clean: frozenset
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, lexicon: Lexicon, texts) -> np.ndarray:
        x = np.array([features(lexicon, t or "") for t in texts]).reshape(-1, FEATURES)
        return calibrated(x @ self.weights, self.knots, self.values)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic", most: int = MAX_FIT) -> Model:
    """A model of ``docs`` whose ids have a label, cross-fitted in two halves; MAX_FIT of them at most, chosen by hash. Of several labels the largest counts."""
    marks = labels.where(F.col(row_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(row_id).alias("of")).agg(F.max(label).cast("int").alias("label"))
    rate = sample_rate(marks.count(), most)
    marks = materialize(marks.where(by_hash(rate, "of", salt="toxicity")), "toxic-labels")
    rows = docs.select(F.col(row_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(marks), "of")  # about ``most`` small rows
    rows = materialize(rows.select("text", "label", (F.pmod(F.xxhash64(F.lit("fold"), "of"), F.lit(2)) == 1).alias("fold")), "toxic-fit")
    halves = [lexicon_of(rows.where(F.col("fold") == bool(k)).select("text", "label")) for k in (0, 1)]

    def known(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Features of each row by the lexicon of the other half, so that they are what new rows will show."""
        lexicons = [_lexicon(*h) for h in halves]
        for f in frames:
            x = [features(lexicons[1 - int(fold)], t or "") for t, fold in zip(f["text"], f["fold"], strict=True)]
            yield pd.DataFrame({"x": x, "label": f["label"].to_numpy(float)})

    seen = materialize(rows.mapInPandas(known, "x array<double>, label double"), "toxic-features")
    weights = ridge(*normal_equations(seen, lambda f: (np.array(f["x"].tolist()).reshape(-1, FEATURES), f["label"].to_numpy()[:, None]), FEATURES, 1), 1e-4)[:, 0]
    raw = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    knots, values = isotonic(seen.select(raw.alias("score"), "label"))
    return Model(*lexicon_of(rows.select("text", "label")), weights, knots, values)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic, in place of a column of that name; null and empty texts get that of a text without hits."""
    docs = docs.drop(into)
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(model.terms, model.clean)
        for f in frames:
            yield f.assign(**{into: model.score(lexicon, f[text])})

    return docs.mapInPandas(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Repeated rows repeat; a null id is not held out and never trains; without labels of both
    kinds every score is that of the labels' majority (0.5 if there are none). No other column than id and text is read."""
    from kadastra.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    scored = score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
