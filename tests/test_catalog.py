"""The table catalogue: a scan from landed rows to scored search results."""

import datetime as dt

from pyspark.sql import functions as F

from kadastra.catalog import Catalog
from kadastra.operators.search import Filters

NOW = "2026-09-30 12:00:00"
KINDS = "id long, source_key string, external_id string, kind string, property_type string, transaction string, title string, price double, price_per_m2 double, initial_price double, city string, county string, voivodeship string, status string, is_original boolean, event_date timestamp, listed_at timestamp, first_seen timestamp, last_seen timestamp, seller_type string, phone string, lat double, lon double, geo_precision string"


def test_scan_and_search(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.create()
    catalog.save("listings", spark.createDataFrame([], KINDS))
    stamp = dt.datetime(2026, 9, 1)
    rows = [(str(i), "nieruchomosc", "mieszkanie", "sprzedaz", f"Oferta {i}", 500000.0, 10000.0 + i if i else 5000.0, "Opole", "Opole", "opolskie", True, stamp) for i in range(10)]
    batch = spark.createDataFrame([("a", *r) for r in rows], "source_key string, external_id string, kind string, property_type string, transaction string, title string, price double, price_per_m2 double, city string, county string, voivodeship string, is_original boolean, listed_at timestamp")
    catalog.scan(batch, F.lit(NOW).cast("timestamp"), ["a"])
    catalog.scan(batch.where("external_id = '0'").withColumn("price", F.lit(450000.0)), F.lit("2026-10-07 12:00:00").cast("timestamp"), ["a"])
    assert catalog.version("listings") == 3 and catalog.table("price_history").count() == 11
    statuses = {r.external_id: r.status for r in catalog.table("listings").collect()}
    assert statuses["0"] == "aktywna" and statuses["1"] == "nieaktywna"
    catalog.scan(batch, F.lit("2026-10-08 12:00:00").cast("timestamp"))
    found = catalog.search(Filters(deal_max=0.85, sort="okazje"), NOW).collect()
    assert [(r.external_id, r.deal_level) for r in found] == [("0", "miasto")]
    assert catalog.stats(NOW).first().active == 10
