"""Sources, sinks and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from kadastra.operators.search import Filters
from kadastra.sources import export, pages, robots
from kadastra.streaming import jobs


def test_robots(spark):
    table = robots.rules(spark, {"a.pl": "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow: /*.pdf$\n\nUser-agent: bot\nDisallow: /\nCrawl-delay: 2.5\n", "b.pl": ""})
    urls = spark.createDataFrame([("https://a.pl/x/1",), ("https://a.pl/x/y1",), ("https://a.pl/d.pdf",), ("https://a.pl/d.pdf?a=1",), ("https://b.pl/x",), ("https://a.pl",)], "url string")
    assert [r.allowed for r in robots.judge(urls, table).orderBy("url").collect()] == [True, False, True, False, True, True]
    assert robots.judge(urls, table, "SomeBot/1.0").where("allowed and url like '%a.pl%'").count() == 0
    assert robots.delays(table, "bot").first().delay == 2.5


def test_json_ld(spark):
    item = {"@type": "Offer", "name": "Dom", "url": "https://x.pl/1", "offers": {"price": "500000", "itemOffered": {"floorSize": {"value": "120"}, "address": {"addressLocality": "Opole"}}}}
    html = f'<script type="application/ld+json">{json.dumps({"@type": "ItemList", "itemListElement": [{"position": 1, "item": item}]})}</script>'
    rows = pages.json_ld_offers(spark.createDataFrame([("u", html), ("v", None), ("w", "<p>")], "url string, html string")).collect()
    assert [(r.title, r.price, r.area, r.city) for r in rows] == [("Dom", 500000.0, 120.0, "Opole")]


def test_rest_offers(spark):
    body = {"id": "7", "url": "u", "title": "t", "params": [{"key": "price", "value": {"value": "100"}}, {"key": "m", "value": {"key": "45"}}], "location": {"city": {"name": "Opole"}}, "map": {"lat": 50.0, "lon": 18.0}, "photos": [{"link": "p"}]}
    r = pages.rest_offers(spark.createDataFrame([(json.dumps(body),), ("broken",)], "value string")).collect()
    assert len(r) == 1 and (r[0].price, r[0].area, r[0].city, r[0].images) == (100.0, 45.0, "Opole", ["p"])


def test_pages(spark):
    rows = spark.createDataFrame([("https://x.pl/oferta/dom-1", "<a href='/a'>x</a><a href='/a'>y</a>"), ("https://x.pl/kategoria/domy", ""), ("https://x.pl/z.pdf", None), ("https://x.pl/kontakt", "")], "url string, html string")
    assert [r.c for r in rows.select(pages.url_class(F.col("url")).alias("c")).collect()] == ["oferta", "lista", "dokument", "formularz"]
    assert [r.n for r in rows.select(F.size(pages.links(F.col("html"))).alias("n")).collect()] == [1, 0, 0, 0]
    table = spark.createDataFrame([("<table><tr><th>Cena:</th><td><b>5 zł</b></td></tr></table>",)], "h string").select(pages.label_table(F.col("h")).alias("t")).first().t
    assert [tuple(x) for x in table] == [("Cena", "5 zł")]


def test_crawl_ends_at_a_page_without_fresh_items(spark):
    rows = [("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 2, 1, "a"), ("s", 2, 2, "b"), ("s", 3, 1, "c"), ("t", 1, 1, "d"), ("t", 2, 1, "a"), ("t", 2, 2, "e")]
    found = pages.crawl_order(spark.createDataFrame(rows, "section string, page int, position int, external_id string"))
    assert sorted(r.external_id for r in found.collect()) == ["a", "b", "d", "e"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "537123123", "secret", dt.datetime(2026, 1, 2))], "id long, phone string, raw string, listed_at timestamp")
    export.write(df, str(tmp_path / "csv"))
    export.write(df, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().phone == "537 *** ***"
    assert "raw" not in spark.read.json(str(tmp_path / "json")).columns
    (tmp_path / "s.yaml").write_text("defaults: {scraper: css}\nsources:\n- {key: a, name: A}\n- {key: b, enabled: false}\n")
    file = export.registry(spark, str(tmp_path / "s.yaml"))
    known = spark.createDataFrame([("a", "old", "x", False), ("z", "gone", "x", True)], "key string, name string, scraper string, enabled boolean")
    assert {r.key: (r.name, r.enabled) for r in export.sync_registry(known, file).collect()} == {"a": ("A", True), "b": (None, False), "z": ("gone", False)}


def test_alert_stream_tells_once(spark, tmp_path):
    kinds = "id long, price double, listed_at timestamp, is_original boolean, status string"
    spark.createDataFrame([(1, 1.0, dt.datetime(2026, 1, 1), True, "aktywna")], kinds).write.json(str(tmp_path / "in"))
    told = []
    channels = spark.createDataFrame([(1, "mail")], "search_id int, channel string")
    sink = jobs.alert_sink(spark, str(tmp_path / "log"), {1: Filters()}, channels, lambda: "2026-01-02 00:00:00", lambda d: told.extend(r.id for r in d.collect()))
    for n in range(2):
        q = spark.readStream.schema(kinds).json(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        if not n:
            spark.createDataFrame([(1, 1.0, dt.datetime(2026, 1, 1), True, "aktywna"), (2, 1.0, dt.datetime(2026, 1, 1), True, "aktywna")], kinds).write.mode("append").json(str(tmp_path / "in"))
    assert sorted(told) == [1, 2]


def test_windows_as_streams(spark, tmp_path):
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=5 * i), i % 2, "view", 1.0) for i in range(50)]
    spark.createDataFrame(rows, kinds).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).json(str(tmp_path / "in"))
    q = jobs.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == 50


def test_snapshots_survive_replay(spark, tmp_path):
    kinds = "id long, source_key string, external_id string, kind string, price double, initial_price double, status string, event_date timestamp, first_seen timestamp, last_seen timestamp"
    first = spark.createDataFrame([], kinds)
    sink = jobs.snapshot_sink(spark, str(tmp_path), first, lambda: "2026-01-02 00:00:00")
    batch = spark.createDataFrame([("a", "1", "nieruchomosc", 5.0)], "source_key string, external_id string, kind string, price double")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.withColumn("price", F.lit(6.0)), 1)
    rows = spark.read.parquet(f"{tmp_path}/snapshot=1").collect()
    assert [(r.price, r.initial_price) for r in rows] == [(6.0, 5.0)]
