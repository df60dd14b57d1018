"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import itertools
import random

from kadastra.llm import near_copies, pipeline, simhash
from tests.llm.helpers import documents, words


def naive_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive_groups(texts):
    """Group number of each text; texts without words are one group."""
    sets, of = [naive_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 10 * len(a & b) >= 8 * len(a | b):
            x, y = top(i), top(j)
            of[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"other{r.randrange(1000)}"
    return " ".join(w)


def test_stage_keeps_one_of_each_group_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = naive_groups([t for _, t in rows])
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, None).collect()]
    assert sorted(got) == [rows[g][0] for g in sorted(set(groups))]


def test_stage_finds_copies_that_differ_in_many_bits_and_spares_others(spark):
    rows = []
    for k in range(30):
        text = words(100 + k, 120)
        rows += [(10 * k + j, edited(text, k * 10 + j, j), "en", "a") for j in range(6)]
    groups = naive_groups([r[1] for r in rows])
    assert len(set(groups)) < len(rows)
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(spark, rows), None).collect()}
    assert got == {rows[g][0] for g in groups}


def test_blocks_agree(spark, monkeypatch):
    rows = [(k, edited(words(1, 150), k, k % 7), "en", "a") for k in range(60)]
    want = {rows[g][0] for g in naive_groups([r[1] for r in rows])}
    for n in (8, 1000):
        monkeypatch.setattr(near_copies, "BLOCK_NODES", n)
        assert {r.doc_id for r in near_copies.one_of_each(documents(spark, rows)).collect()} == want


def test_rows_without_an_id_or_with_one_id_stay_and_are_decontaminated(spark, tmp_path):
    item = words(77, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, words(k, 60), "en", "a") for k in range(5)] + [(7, words(10 + k, 60), "en", "a") for k in range(5)]
    leaks = [(None, words(20, 40) + " " + item, "en", "a"), (7, words(21, 40) + " " + item, "en", "a")]
    again = [(None, words(0, 60), "en", "b"), (9, words(1, 60), "en", "a"), (7, words(10, 60), "en", "a")]
    docs = pipeline.drop_near_duplicates(spark, documents(spark, rows + leaks + again).repartition(5), None)
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert got == sorted([(i or 0, t) for i, t, *_ in rows[:1] + rows[2:] + leaks + again[1:2]])
    clean = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == [x for x in got if item not in x[1]]
    mixed = {(r.doc_id, r.text) for r in pipeline.mix_sources(spark, clean.withColumn("source", clean["text"]), None).collect()}
    assert any(i is None for i, _ in mixed)


def test_stage_takes_candidates_of_operator_9(spark, monkeypatch):
    """Without the bands the stage still finds what fingerprints of 4 bits connect; the exact check spares other texts of one fingerprint."""
    calls, operator = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(1) or operator(*a, **k))
    rows = [(10 * k + j, edited(words(300 + k, 400), k * 10 + j, j), "en", "a") for k in range(20) for j in range(3)]
    junk = [(1000 + k, "ha " * 500 + words(400 + k, 200), "en", "a") for k in range(2)]
    assert len({simhash.fingerprint(t) for _, t, *_ in junk}) == 1 and len(set(naive_groups([t for _, t, *_ in junk]))) == 2
    docs = documents(spark, rows + junk + [(2000, rows[0][1], "en", "b"), (None, None, "en", "b")])
    groups = naive_groups([t for _, t, *_ in rows + junk])
    want = {(rows + junk)[g][0] for g in groups} | {None}
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, None).collect()} == want and calls == [1]
    monkeypatch.setattr(near_copies, "by_bands", lambda sketches: sketches.selectExpr("node", "node as key").where("false"))
    texts = {i: (simhash.fingerprint(t), naive_set(t)) for i, t, *_ in rows}
    near = {j for i, j in itertools.combinations(texts, 2) if (texts[i][0] ^ texts[j][0]).bit_count() <= 4 and 10 * len(texts[i][1] & texts[j][1]) >= 8 * len(texts[i][1] | texts[j][1])}
    assert near
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, None).collect()} == {i for i, *_ in rows + junk} - near | {None}
