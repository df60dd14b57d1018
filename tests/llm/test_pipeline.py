"""The corpus pipeline: stages on what the ones before kept, decisions that take effect, awkward tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from kadastra.llm import decontamination, pipeline, toxicity
from tests.llm.helpers import awkward, documents, words


def near_groups(rows):
    """Brute force: the smallest id of each group that pairs with a five-word Jaccard similarity of 0.8 or more connect."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i, _ in rows}


def test_stages_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = stage(spark, docs, sf).checkpoint()
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == near_groups([(i, t) for i, t, _ in before])
    before, after = seen["decontamination"]
    bench = [decontamination.shingles(decontamination.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, t, _ in before if not any(sum(s in set(decontamination.shingles(decontamination.words_of(t))) for s in b) >= 0.8 * len(b) for b in bench)}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = seen["sharding"]
    assert after.count() == len(before) and after.select("shard", "slot").distinct().count() == len(before)


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rows = [(i, words(i, 60) + (" you idiot moron" if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert kept == {i for i in range(400) if i % 4}
    assert toxicity.THRESHOLD == 0.3


def test_awkward_and_empty_tables(spark, tmp_path):
    """Of the awkward rows the near copies and the one with a benchmark passage go, and nothing else; names of ours may be taken."""
    spark.createDataFrame([(6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = "eins zwei drei vier fünf sechs sieben acht neun zehn"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*awkward(), (None, words(41, 30), "en", "b"), (4, words(42, 30), "en", "b"), (None, words(2, 30) + f". {item}.", "en", "b")]
    taken = {c: F.lit(1) for c in ("key_of_stage", "copies_of_stage", "copy_of_stage", "toxicity_of_stage", "K1_of_stage")}
    for some in (rows, []):
        docs = documents(spark, some).withColumns(taken)
        seen = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{name}-{len(some)}")
            out.write.parquet(path)
            if name != "sharding":
                assert out.columns == docs.columns
            docs = spark.read.schema(out.schema).parquet(path)
            seen.append(sorted((r.text or "" for r in docs.collect()), key=lambda t: (len(t), t)))
        if not some:
            assert not any(seen)
            continue
        toxic, near, clean, mixed, shards = seen
        wordless = [t for t in toxic if not t.split()]  # one group, of which the smallest id stays
        assert near == sorted({t for t in toxic if t.split()} | set(wordless[:1]), key=lambda t: (len(t), t))
        assert set(clean) == {t for t in near if item not in t}
        assert set(mixed) <= {t for t in clean if t.split()} and shards == mixed


def test_map_columns_pass_through(spark, tmp_path):
    """Columns that Spark cannot hash: maps count by their entries, whatever their order."""
    spark.createDataFrame([(1, "eins zwei drei vier fünf sechs sieben")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, words(1, 40), {"a": "1", "b": "2"}), (1, words(1, 40), {"b": "2", "a": "1"}), (2, words(1, 40), None), (3, words(3, 40), {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>").selectExpr("*", "'s' AS source", "array(extra) AS deep")
    kept = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs.columns
    mixed = pipeline.mix_sources(spark, pipeline.drop_contaminated(spark, kept, str(tmp_path)), str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} == {1, 3}
