"""The training-data operators against brute force, and on awkward and empty tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kadastra.llm import decontamination, exact_dedup, html_extraction, language_id, mixing, models, quality, sharding, simhash, substring_dedup, toxicity
from tests.llm.helpers import SCHEMA, awkward, documents, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, awkward()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


# 1 ------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, corpus):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(corpus, bench).collect()}
    items = {r.item_id: decontamination.shingles(decontamination.words_of(r.text)) for r in bench.collect()}
    want = set()
    for d in corpus.collect():
        there = set(decontamination.shingles(decontamination.words_of(d.text)))
        want |= {(d.doc_id, i) for i, s in items.items() if sum(x in there for x in s) >= 0.8 * len(s)}
    assert got == want and want


def test_decontamination_finds_items_anywhere_and_of_any_length(spark):
    items = [(1, words(50, 20) + ". " + words(51, 6) + "."), (2, words(52, 300) + "."), (3, "eins zwei drei"), (4, None), (5, ""), (6, "Frage eins zwei drei vier fünf. Antwort.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(100 + i, 37 * i) + " " + items[0][1].upper() + " " + words(200 + i, 90), "en", "a") for i in range(6)]
    rows += [(10, words(3, 500) + items[1][1] + words(4, 100), "en", "a"), (11, "so eins zwei drei so", "de", "a"), (12, words(5, 900), "en", "a"), (13, words(6, 200) + "\n" + " ".join(items[0][1].split()[:12]), "en", "a")]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(i, 1) for i in range(6)} | {(10, 2), (11, 3)}


def test_decontamination_asks_for_the_answer(spark):
    question, answer = words(71, 40), "vier ganz andere worte"
    bench = spark.createDataFrame([(1, f"{question}. {answer}.")], "item_id long, text string")
    around = words(72, 100)
    rows = [(1, f"{around} {question} {around}", "en", "a"), (2, f"{around} {question}. {answer} {around}", "en", "a"), (3, f"{answer} {around}", "en", "a")]
    hits = decontamination.contaminated(documents(spark, rows), bench).collect()
    assert [(r.doc_id, r.question_overlap, r.answer_overlap) for r in hits] == [(2, 1.0, 1.0)]


def test_decontamination_parts_of_the_index_agree(spark, corpus, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in decontamination.contaminated(corpus, bench).select("doc_id", "item_id", F.round("score", 6)).collect()}
    monkeypatch.setattr(decontamination, "PART_POSTINGS", 300)
    assert {tuple(r) for r in decontamination.contaminated(corpus, bench).select("doc_id", "item_id", F.round("score", 6)).collect()} == whole


def test_decontamination_awkward(spark, odd, none):
    bench = spark.createDataFrame([(1, words(3, 80)), (1, words(3, 80)), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(odd, bench).collect()} == {6, 7}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------


def test_html_of_given_pages_is_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as entities

    for r in html_extraction.extract(pages).collect():
        body = html[r.page_id]
        body = body[body.find("<article>") + 9 : body.rfind("</article>")]
        lines = entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", "\n", body))).split("\n")
        want = "\n".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in lines) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_html_chrome_goes_and_differences_decide_without_markup(spark):
    rows = [
        (1, "https://a.pl/x/1", "<body><div>Menu główne</div><p>Treść   pierwsza &amp; ważna</p><p>Druga</p><p>Koniec strony</p>"),
        (2, "https://a.pl/x/2", "<body><div>Menu główne</div><p>Całkiem co innego</p><p>Koniec strony</p>"),
        (3, "https://b.pl/1", "<article><h1>T</h1><aside>x</aside><form>f</form><p>a<br>b</p><div class='comments'>c</div><div class='ad'>r</div></article><footer>s</footer>"),
        (4, "https://b.pl/2", "<article><h1>T</h1><p>a<br>b</p></article>"),
        (5, None, None), (6, "", ""), (7, "https://c.pl/", "<p>sam</p><script>var t='</p>'</script><nav>n</nav>"), (8, "https://d.pl/1", "<p>to samo</p><p>i tu</p>"), (9, "https://d.pl/2", "<p>to samo</p><p>i tu</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert got == {1: "Treść pierwsza & ważna\nDruga", 2: "Całkiem co innego", 3: "T\na\nb", 4: "T\na\nb", 5: "", 6: "", 7: "sam", 8: "to samo\ni tu", 9: "to samo\ni tu"}
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert len(html_extraction.shared(a, b)) == table[-1, -1]


def test_alignment_of_long_pages_in_halves(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = ([str(x) for x in rng.integers(0, 30, 700)] for _ in range(2))
    whole = html_extraction.shared(a, b)
    monkeypatch.setattr(html_extraction, "TABLE_BITS", 500)
    halves = html_extraction.shared(a, b)
    assert len(whole) == len(halves)
    it = iter(b)
    assert all(any(x == y for y in it) for x in (a[i] for i in sorted(halves)))
    assert len(html_extraction.shared(["x"] * 20_000, ["x"] * 9_000 + ["y"] + ["x"] * 11_000)) == 20_000


def test_a_template_without_names_goes(spark):
    """Nine lines of template and one own line; a copy of a page does not empty it; names inside an article count if shared."""
    template = "".join(f"<div>Linia szablonu {k}</div>" for k in range(9))
    rows = [(i, f"https://e.pl/a/{i}", f"<body>{template}<p>Artykuł numer {i}</p>") for i in (1, 2, 3)]
    rows += [(4, "https://f.pl/x/1", "<body><div>menu</div><p>jeden</p><p>dwa</p>"), (5, "https://f.pl/x/2", "<body><div>menu</div><p>jeden</p><p>dwa</p>"), (6, "https://f.pl/x/3", "<body><div>menu</div><p>trzy</p>"), (11, "https://f.pl/x/0", "<body><div>menu</div><p>zero</p>")]
    rows += [(7, "https://g.pl/1", "<html><head><title>t</title><body><main><h1>Tytuł</h1><div class='notice'>Ważne dla tej strony</div><div class='share'>Udostępnij</div></main>"), (8, "https://g.pl/2", "<main><h1>Tytuł</h1><div class='share'>Udostępnij</div><p>b</p></main>")]
    rows += [(None, "https://h.pl/1", "<p>a</p>"), (9, "https://h.pl/1", "<p>a</p>"), (9, "https://h.pl/1", "<p>a</p>"), (10, "https://h.pl/2", "<p>" + "słowo " * 200_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in range(1, 9)] == ["Artykuł numer 1", "Artykuł numer 2", "Artykuł numer 3", "jeden\ndwa", "jeden\ndwa", "trzy", "Tytuł\nWażne dla tej strony", "Tytuł\nb"]
    assert sorted(r.text for r in got if r.url == "https://h.pl/1") == ["a"] * 3 and len(text[10]) == 200_000 * 6 - 1


def test_pages_meet_the_same_neighbours_however_they_are_dealt(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    results = []
    for least, parts in ((32, 4), (1, 40), (7, 5)):
        monkeypatch.setattr(html_extraction, "LEAST_PAGES", least)
        results.append(sorted(map(tuple, html_extraction.extract(pages.repartition(parts)).collect())))
    assert results[0] == results[1] == results[2] and sum(r[4] for r in results[0]) > 0


# 3, 6, 7 ------------------------------------------------------------------------------------------


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and len(got) == 1000
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    x = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert auc(x.quality.to_numpy(), x.score.to_numpy()) > 0.97


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, sf).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all() and len(got) == 1000
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    x = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert auc(x.toxic.to_numpy(), x.score.to_numpy()) > 0.75


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op7_language_id(spark, sf).toPandas()
    x = got[got.held_out].merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (x.lang == x.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_classifiers_awkward(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 4, 5, 6, 7, 8)] + [(4, 1, 0), (None, 1, 1), (99, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit, quality.score), (toxicity.fit, toxicity.score)):
        for known in (labels, labels.limit(0)):
            model = fit(odd, known)
            assert ids(score(odd, model)) == ids(odd) and sorted(score(odd, model).columns) == sorted(odd.columns)  # ``score`` is replaced
            assert score(odd, model).where("score is null or score < 0 or score > 1").count() == 0
            assert score(none, model).count() == 0
    for docs in (odd, none):
        found = language_id.predict(odd, language_id.fit(docs))
        assert ids(found) == ids(odd)
        assert {r.lang_pred for r in found.where("doc_id in (1, 2, 3)").collect()} == {"und"}


def test_rare_languages_are_learnt(spark):
    """A language of thirty rows beside thousands stays in a fit of few rows; there is no limit to the number of languages."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, words(i, 30), "en", "a") for i in range(3000)] + [(5000 + i, words(i, 30, stock=["zażółć", "gęślą", "jaźń", "łąka"]), "pl", "a") for i in range(30)]
    rows += [(9000 + 10 * k + i, " ".join(letters[k % 26] * 3 + letters[k // 26] * 2 for _ in range(20)), f"l{k:03}", "a") for k in range(260) for i in range(4)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    model = language_id.fit(docs, most=300)
    assert len(model.languages) == 262
    got = {r.lang: r.ok for r in language_id.predict(docs, model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).collect()}
    assert got["pl"] == 1.0 and got["en"] > 0.95 and sum(v > 0.9 for v in got.values()) > 250


def test_trie_finds_all_words_at_one_edit():
    rng = np.random.default_rng(2)
    terms = ["idiot", "worthless", "clown", "scummy"]
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t, 1.0, False)
    trie.add("vequ", 2.0, True)

    def distance(a, b):
        if any(a == b[:i] + b[i + 1] + b[i] + b[i + 2 :] for i in range(len(b) - 1)):
            return int(a != b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        return new

    tried = set(terms)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(1, 3)):
                k = int(rng.integers(0, len(w)))
                w[k : k + int(rng.integers(0, 2))] = [] if rng.random() < 0.4 else [chr(97 + int(rng.integers(0, 26)))]
            tried.add("".join(w))
        tried |= {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)}
    for w in tried:
        near = min(distance(w, t) for t in terms) == 1
        if w not in terms:
            assert bool(trie.near(w)) is (near and len(w) >= 4), w
    assert trie.exact("vequation") == 2.0 and trie.exact("veq") == 0.0 and trie.exact("idiot") == 1.0 and trie.exact("idiots") == 0.0


def test_quotation_scores_less_than_abuse():
    lexicon = toxicity._lexicon([("idiot", 5.0)])
    plain, quoted = (toxicity.features(lexicon, t)[8] for t in ("you are an idiot and all know it", 'he said "you are an idiot and" all know it'))
    assert quoted < plain


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.STATISTICS))
    w = rng.normal(size=(quality.STATISTICS, 4000)) / np.sqrt(quality.STATISTICS)
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), w, rng.uniform(0, 2 * np.pi, 4000), np.zeros(1), np.zeros(1), np.zeros(1))
    z = model.expand(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gap / 2 / quality.STATISTICS)).max() < 0.12


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=2000)
    rows = spark.createDataFrame(pd.DataFrame({"score": s, "label": (rng.random(2000) < 1 / (1 + np.exp(-3 * s))).astype(float)}))
    knots, values = models.isotonic(rows)
    p = models.calibrated(np.linspace(-5, 5, 200), knots, values)
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1 and abs(p[100] - 0.5) < 0.15


# 4 ------------------------------------------------------------------------------------------------


def test_mixing_reaches_its_targets(spark, corpus):
    got = mixing.mix(corpus).toPandas()
    assert len(got) == corpus.count() and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = {r.doc_id: len(word.findall(r.text or "")) for r in corpus.collect()}
    assert (got["size"] == got.doc_id.map(sizes)).all()
    total = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), copies=("copies", "sum"))
    assert ((total.taken - total.target).abs() <= 0.1 * total.target).all()  # ten documents a source
    assert abs(got.groupby("source").target.first().sum() - got["size"].sum()) < 1e-3 * got["size"].sum()
    again = mixing.mix(corpus.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_targets():
    assert mixing.targets([10, 10, 10, 10], [5, 2, 1, 5]) == pytest.approx([200 / 13, 80 / 13, 40 / 13, 200 / 13])
    assert mixing.targets([1, 100], [5, 2]) == pytest.approx([3, 98])
    assert mixing.targets([0, 7], [5, 2]) == pytest.approx([0, 7]) and mixing.targets([], []) == []


def test_the_flight_decides_nearly_all_words(spark):
    """At fifty documents a source: targets within 1 %, documents within one, 95 % of the words decided in flight."""
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    total = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), copies=("copies", "sum"), n=("size", lambda x: (x > 0).sum()), size=("source_size", "first"))
    assert ((total.taken - total.target).abs() <= 0.01 * total.target).all()
    assert ((total.copies - total.target / total["size"] * total.n).abs() <= 2).all()
    assert got[got.landed]["size"].sum() < 0.05 * got["size"].sum() and got.groupby("source").landed.sum().max() <= mixing.LANDING


def test_inclusion_follows_the_fractions(spark, none):
    """Over many seeds each document, long or short, is taken as often as its fraction says; buckets and rounds included."""
    sizes = np.r_[20_000, 9_000, np.random.default_rng(3).integers(1, 300, 60)].astype(float)
    p, n = np.full(len(sizes), 0.37), 600
    order = np.argsort(-sizes)
    taken = np.zeros(len(sizes))
    for seed in range(n):
        out = mixing.flight(sizes[order], p, np.random.default_rng(seed).random)
        taken[order] += out
    assert np.abs(taken / n - 0.37).max() < 5 * np.sqrt(0.37 * 0.63 / n)


def test_mixing_in_many_buckets_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, words(i, 5 + i % 40), "en", f"s{i % 2}") for i in range(900)] + [(None, "x y z", "en", "s0")] * 50
    got = mixing.mix(documents(spark, rows)).toPandas()
    total = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(got) == 950 and ((total.taken - total.target).abs() <= 0.005 * total.target).all()


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(5)
    sizes, p = rng.integers(1, 300, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(sizes, p, rng.random)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((sizes * out).sum() - (sizes * p).sum()) < 1e-6 * sizes.sum() and abs(out.sum() - p.sum()) < 1e-6


def test_mixing_awkward(odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and got[got["size"] == 0].taken.sum() == 0 and (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(none).count() == 0


# 5 ------------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_equal_texts_together(spark, corpus):
    got = sharding.shard(corpus, 8).toPandas()
    own = {r.doc_id: r.text for r in corpus.collect()}
    assert len(got) == len(own) and (got["size"] == got.doc_id.map(lambda i: len(own[i].encode()) + 1)).all()
    assert (got.text_crc32 == got.doc_id.map(lambda i: zlib.crc32(own[i].encode()))).all()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 2 * got["size"].max()
    assert (got.assign(t=got.doc_id.map(own)).groupby("t").shard.nunique() == 1).all()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_sharding_awkward(spark, odd, none):
    got = sharding.shard(odd, 8, keep=("lang", "source")).toPandas()
    assert len(got) == odd.count() and got[got.doc_id.isin([1, 2])].shard.nunique() == 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert sharding.shard(none, 8).count() == 0
    same = documents(spark, [(i, "the same text", "en", "a") for i in range(50)])
    assert sharding.shard(same, 8).select("shard").distinct().count() == 1


# 8 ------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_its_sql(spark):
    got = exact_dedup.op8_exact_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(exact_dedup.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[got.columns.tolist()]
    assert got.astype(str).equals(want.astype(str))


def test_exact_dedup_awkward(spark, odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {2} and {r.group_size for r in empty} == {3} and [r.doc_id for r in empty if r.kept] == [2]
    assert all(r.kept and r.group_size == 2 for r in by[hashlib.sha256(b"x").hexdigest()])
    assert all(r.kept for r in by[hashlib.sha256(words(2, 30).encode()).hexdigest()])
    assert exact_dedup.exact_dedup(none).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup.exact_dedup(hot).where("kept").count() == 1001


def test_cuckoo_filter_inserts_deletes_and_grows():
    index = exact_dedup.DigestIndex(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.insert(k, 1, i, 1)
    index.insert(keys[7], 1, 9999, 2)
    assert index.resizes > 0 and all(index.find(k, 1) for k in keys) and index.stored[keys[7]] == [1, 9999, 3]
    assert index.find(keys[0], 2) is None and index.find(hashlib.sha256(b"other").digest(), 1) is None
    assert all(index.delete(k, 1) for k in keys[:2000]) and not index.delete(keys[0], 1) and not index.find(keys[7], 1)
    assert all(index.find(k, 1) for k in keys[2000:]) and not any(index.find(k, 1) for k in keys[10:2000])


def test_digest_index_updates(spark):
    """After each batch the index is what building it from the live rows gives; the kept row may be the one that goes."""
    of = lambda rows: exact_dedup.digests(documents(spark, [(*r, "en", "a") for r in rows]))
    rows = [(i, f"t{i % 5}") for i in range(10)] + [(3, "t3"), (None, "t4")]
    index, live = exact_dedup.build_index(of(rows)), exact_dedup.live_rows(of(rows))
    for added, removed in (([(20, "t0"), (21, "neu")], [(1, "t1"), (6, "t1"), (7, "t2"), (77, "nie da"), (5, "t4")]), ([(7, "t2")], [(20, "t0"), (3, "t3"), (9, "t4"), (4, "t4"), (None, "t4")]), ([], [])):
        index, live = exact_dedup.update_index(index, live, of(added), of(removed), 3)
        rows = rows + added
        for r in removed:
            if r in rows:
                rows.remove(r)
        want = exact_dedup.build_index(of(rows))
        plain = lambda df: sorted((bytes(r.digest), r.keep_id, r.group_size) for r in df.collect())
        assert plain(index) == plain(want)


# 9 ------------------------------------------------------------------------------------------------


def naive_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(prints):
    items = [(i, f) for i, f in prints if i is not None]
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in items:
        for j, g in items:
            if bin(f ^ g).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_simhash_against_brute_force(spark, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(corpus).collect()}
    prints = [(r.doc_id, naive_fingerprint(r.text)) for r in corpus.collect()]
    parts = naive_components(prints)
    assert got == {i: (f"{f:016x}", parts[i]) for i, f in prints}


def test_large_keys_are_compared_in_blocks(spark, corpus, monkeypatch):
    """Distinct near copies that share their keys, in blocks of four: the same groups as in one piece."""
    base = words(77, 400).split()
    rows = [(i, " ".join([*base[:i], f"inny{i}", *base[i + 1 :]]), "en", "a") for i in range(60)]
    docs = documents(spark, rows).select("doc_id", "text").unionByName(corpus.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_awkward(odd, none):
    got = simhash.near_duplicates(odd).collect()
    parts = naive_components([(r[0], naive_fingerprint(r[1])) for r in awkward()])
    assert len(got) == odd.count() and all(r.component_id == parts[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    of = []
    for x in (a, b):
        found = collections.defaultdict(set)
        for r, k in zip(*simhash.keys(x), strict=True):
            found[int(r)].add(int(k))
        of.append(found)
    assert all(of[0][i] & of[1][i] for i in range(len(a)))


def test_golay_code_is_perfect():
    g = simhash.GOLAY
    m = np.arange(1 << 12)
    code = (m << 11) | g.parity
    rng = np.random.default_rng(1)
    for _ in range(5):
        noise = np.zeros(len(m), np.int64)
        for bit in rng.choice(23, 3, replace=False):
            noise ^= 1 << int(bit)
        assert (g.index(code ^ noise) == m).all()


# 10 -----------------------------------------------------------------------------------------------


def repeated_documents(rows, least=substring_dedup.MIN_WORDS):
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - least + 1):
            seen[b" ".join(w[k : k + least])].add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def test_substring_dedup_against_brute_force(spark, corpus):
    got = {r.doc_id for r in substring_dedup.repeats(corpus).collect()}
    want = repeated_documents([(r.doc_id, r.text) for r in corpus.collect()])
    assert got == want and want


def test_substring_dedup_of_ids_that_do_not_tell_documents_apart(spark):
    """Rows without an id, with one id and different texts, and repeated rows; copies and passages mixed."""
    a, b, c = words(1, 90), words(2, 60), words(3, 70)
    rows = [(None, a + " " + words(4, 40)), (None, words(5, 40) + " " + a), (5, b + " " + words(6, 30)), (5, words(7, 30) + " " + b), (6, words(8, 80)), (6, words(8, 80)), (7, a + " " + c), (8, a + " " + c)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = substring_dedup.repeats(docs).collect()
    assert {r.doc_id for r in got} == {None, 5, 7, 8}
    assert sum(r.kept for r in got if r.doc_id == 5) == 1 and sum(not r.kept for r in got if r.doc_id == 5) == 1
    left = [r.text for r in substring_dedup.remove_repeats(docs).collect()]
    for passage in (a, b, c):  # each stays in one document, but for a few words at its ends
        inner = " ".join(passage.split()[12:-12])
        assert sum(inner in t for t in left) == 1
    assert left.count(words(8, 80)) == 2


def test_passages_of_different_documents_make_no_passage_together(spark):
    """Thirty words of one document beside thirty of another are no passage of sixty."""
    x, y = words(11, 30), words(12, 30)
    rows = [(1, words(13, 60) + " " + x + " " + words(14, 50)), (2, words(15, 60) + " " + y + " " + words(16, 50)), (3, words(17, 40) + " " + x + " " + y + " " + words(18, 40))]
    assert not substring_dedup.repeats(documents(spark, [(i, t, "en", "a") for i, t in rows])).count()


def test_rows_of_repeated_words_are_passages(spark):
    rows = []
    for k, period in enumerate((1, 2, 3, 5, 8)):
        row = " ".join((words(50 + k, period) + " ") .strip() for _ in range(120 // period))
        rows += [(10 * k, words(60 + k, 41 + k) + " " + row + " " + words(70 + k, 30), "en", "a"), (10 * k + 1, words(80 + k, 50 - k) + " " + row + " " + words(90 + k, 30), "en", "a")]
    assert {r.doc_id for r in substring_dedup.repeats(documents(spark, rows)).collect()} == {r[0] for r in rows}


def test_passages_of_all_lengths(spark):
    rows = []
    for k, n in enumerate(range(40, 70)):
        passage = words(1000 + k, n)
        rows += [(10 * k, words(2000 + k, 60 + k) + " " + passage + " " + words(3000 + k, 50), "en", "a"), (10 * k + 1, words(4000 + k, 11) + " " + passage + "\n" + words(5000 + k, 90 + k), "en", "a")]
    got = {r.doc_id for r in substring_dedup.repeats(documents(spark, rows)).collect()}
    assert got == repeated_documents([(r[0], r[1]) for r in rows])


def test_cuts_resist_shifts():
    w = words(7, 400).encode().split()
    own, _ = substring_dedup.cuts(w)
    moved, _ = substring_dedup.cuts(words(8, 23).encode().split() + w)
    assert len({int(c) + 23 for c in own[3:]} & set(moved.tolist())) >= len(own) - 4
    assert substring_dedup.cuts([])[0].tolist() == [0] and np.diff(substring_dedup.cuts([b"ha"] * 1000)[0]).max() <= substring_dedup.LONGEST


def test_substring_dedup_awkward(spark, odd, none):
    got = substring_dedup.repeats(odd).collect()
    assert {r.doc_id for r in got} == {6, 7} and sorted(r.kept for r in got) == [False, True]
    assert substring_dedup.repeats(none).count() == 0
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(odd.where("doc_id in (6, 7, 9)")).collect()}
    assert left[6] == words(3, 80) and len(left[7].split()) < 12 and left[9] == [r[1] for r in awkward() if r[0] == 9][0]


def test_schema_constant(spark):
    assert documents(spark, []).columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div id='content-sidebar-wrap'><article><p>One</p></article></div><div class=sidebar>x</div>", "One"),
        ("<article class='post comments-open'>Two<div class='comments'>no</div></article><ol class=comments><li><article class='comment'>no</article></ol>", "Two"),
        ("<div class='page no-ads'><article>Three</article></div>", "Three"),
        ("<div class='widget'><main>Four</main></div><div class='related'>no</div>", "Four"),
        ("<form><div><article>In a form</article></div><input></form><nav>no</nav>", "In a form"),
        ("<div class=comments><article>teaser</article></div><article>real</article>", "real"),
        ("<p>Join <button>ok</button> now</p>", "Join now"),
        ("<div>a<button>b</div><p>c</p>", "a\nc"),
        ("<div class='ads-page'><p>only this</p></div><form>login</form>", "only this"),
        ("<article></article><div class=comments>no</div><form>login</form>", ""),
    ],
)
def test_content_wins_over_names(html, text):
    assert html_extraction.main_text(html_extraction.blocks(html), [])[0] == text


def test_deep_nesting_takes_linear_time():
    deep = html_extraction.blocks("<div>" * 100_000 + "x" + "</div>" * 100_000 + "<span>" * 50_000 + "<p>a<li>b" * 10_000)
    assert len(deep) == 20_001
