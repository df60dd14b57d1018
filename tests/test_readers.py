"""Readers chosen by the registry, on a folder of landed documents and on a stream of its files."""

import json

import pytest
from pyspark.sql import functions as F

from kadastra.sources import cards, readers

NOW = "2026-09-30 12:00:00"
STATE = '<script>window.__INITIAL_STATE__ = {"offerList": {"offers": {"offers": [%s]}}};</script>'
LD = '<script type="application/ld+json">%s</script>'
DOCUMENTS = [
    ("one", "https://a.pl/1", STATE % '{"id": "s1", "slug": "s1", "name": "Dom", "price": {"total": "500000"}}', None),
    ("one", "https://a.pl/2", STATE % '{"id": "s2", "slug": "s2", "name": "Lokal"}', None),
    ("one", "https://a.pl/3", "no state here", None),
    ("one", "https://a.pl/4", None, None),
    ("two", "https://b.pl/1", LD % json.dumps({"@type": "Apartment", "name": "Kawalerka", "url": "https://b.pl/k", "offers": {"price": "1000"}}), None),
    ("gazette", "https://c.pl", json.dumps({"list": [{"id": "9", "entityName": "Syndyk masy", "monitorNumber": "7/2026"}]}), "lokal"),
    ("gazette", "https://c.pl/2", json.dumps({"list": [{"id": "9", "entityName": "Syndyk masy", "monitorNumber": "7/2026"}]}), "dom"),
    ("selected", "https://d.pl/", '<div class="card"><a href="/x"><h2>Działka 10 ar</h2></a><b>120 000 zł</b></div>', None),
    ("off", "https://e.pl/1", STATE % '{"id": "s9", "slug": "s9", "name": "Dom"}', None),
    ("nobody", "https://f.pl/1", STATE % '{"id": "s8", "slug": "s8", "name": "Dom"}', None),
    (None, "https://g.pl/1", STATE % '{"id": "s7", "slug": "s7", "name": "Dom"}', None),
]
SOURCES = [("one", "state", True), ("two", "json_ld", True), ("gazette", "notices_by_phrase", True), ("selected", "generic", True), ("off", "state", False)]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(SOURCES, readers.SOURCE)


@pytest.fixture(scope="module")
def selectors(spark):
    return spark.createDataFrame([("selected", "div.card", "a", "h2", "b", None, None, None, None, "nieruchomosc", None, None)], cards.SOURCE)


def told(df):
    return sorted((r.source_key, r.scraper, r.external_id or "", r.title, r.price or 0.0) for r in df.collect())


def test_each_source_has_its_reader(spark, registry, selectors):
    documents = spark.createDataFrame(DOCUMENTS, readers.LANDED)
    got = readers.read(documents, registry, F.lit(NOW).cast("timestamp"), selectors)
    assert told(got) == [
        ("gazette", "notices_by_phrase", "9", "Obwieszczenie MSiG 7/2026: Syndyk masy", 0.0),
        ("one", "state", "s1", "Dom", 500000.0),
        ("one", "state", "s2", "Lokal", 0.0),
        ("selected", "generic", "", "Działka 10 ar", 120000.0),
        ("two", "json_ld", "https://b.pl/k", "Kawalerka", 1000.0),
    ]
    assert got.where("source_key = 'gazette'").first().phrase == "dom"
    assert readers.read(documents.limit(0), registry, F.lit(NOW).cast("timestamp"), selectors).count() == 0


def test_folder_and_stream_read_the_same(spark, registry, selectors, tmp_path):
    folder, out = str(tmp_path / "landed"), str(tmp_path / "offers")
    for part in (DOCUMENTS[:3], DOCUMENTS[3:6], DOCUMENTS[7:]):  # a gazette's notice is one offer in each batch
        readers.land(spark.createDataFrame(part, readers.LANDED).coalesce(1), folder)
    whole = readers.read(readers.landed(spark, folder), registry, F.lit(NOW).cast("timestamp"), selectors)
    sink = readers.offers_sink(out, registry, lambda: NOW, selectors)
    for _ in range(2):  # the second start has nothing to do
        stream = readers.arriving(spark, folder, 1).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    assert told(spark.read.option("mergeSchema", True).parquet(out)) == told(whole) and whole.count() == 5
    plan = readers.read(readers.landed(spark, folder), registry.where("key = 'one'"), F.lit(NOW).cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(source_key" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_registry_is_checked(spark, registry):
    documents, now = spark.createDataFrame(DOCUMENTS, readers.LANDED), F.lit(NOW).cast("timestamp")
    with pytest.raises(ValueError, match="no reader named other"):
        readers.read(documents, spark.createDataFrame([("one", "other", True)], readers.SOURCE), now)
    with pytest.raises(ValueError, match="selectors"):
        readers.read(documents, registry, now)
    assert readers.read(documents, registry.limit(0), now).count() == 0
