"""Registered queries: state changes, repairs, duplicates, exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import text
from kadastra.operators import duplicates, places, repair, search, upsert
from kadastra.operators.search import Filters
from kadastra.operators.skew import shared_dir
from kadastra.plans.views import LISTINGS_SQL, NOW, listings, table
from kadastra.sources import export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = f"with {LISTINGS_SQL}\n"
_NOW = f"timestamp '{NOW}'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder of the session, compressed and by columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _current(df: DataFrame) -> DataFrame:
    return df.where("id % 10 < 8").select("id", "source_key", F.col("id").cast("string").alias("external_id"), "kind", "price", "initial_price", "city", "street", "status", "lat", "lon", F.col("geo_precision"), "event_date", "first_seen", F.col("first_seen").alias("last_seen"))


def _batch(df: DataFrame) -> DataFrame:
    price = F.when(F.col("id") % 7 == 0, F.col("price") * 0.9).when(F.col("id") % 7 != 1, F.col("price"))
    street = F.when(F.col("id") % 11 == 0, F.lit("ul. Nowa 1")).when(F.col("id") % 11 == 1, F.lit("")).otherwise(F.col("street"))
    cleared = F.when(F.col("id") % 7 == 1, F.array(F.lit("price"))).otherwise(F.array().cast("array<string>"))
    return df.where("id % 10 >= 5").select("source_key", F.col("id").cast("string").alias("external_id"), "kind", price.alias("price"), "city", street.alias("street"), "event_date", F.when(F.col("id") % 77 == 0, F.col("lat") + 0.5).alias("lat"), F.when(F.col("id") % 77 == 0, F.col("lon") + 0.5).alias("lon"), F.when(F.col("id") % 77 == 0, F.lit("portal")).alias("geo_precision"), cleared.alias("cleared"))


_UPSERT = f"""{W}, o as (select *, id % 10 < 8 as here, id % 10 >= 5 as there from listings),
m as (select *, case when not there then price when id % 7 = 1 then null when id % 7 = 0 then price * 0.9 else price end as new_price,
case when not there then street when id % 11 = 0 then 'ul. Nowa 1' when id % 11 = 1 and not here then null else street end as new_street from o where here or there)"""


@query("upsert_merge", f"""{_UPSERT} select source_key, cast(id as string) as external_id, round(new_price, 4) as price, new_street as street,
case when not here then 'new' when not there then 'kept' when new_price is distinct from price or new_street is distinct from street then 'updated' else 'unchanged' end as change,
case when not there then status when kind in ('licytacja', 'przetarg') and event_date < timestamp '2001-07-31 14:00:00' then 'nieaktywna' else 'aktywna' end as status,
case when not here then case when id % 77 = 0 then round(lat + 0.5, 4) end when here and there and new_street is distinct from street then case when id % 77 = 0 then round(lat + 0.5, 4) end when there and id % 77 = 0 then round(lat + 0.5, 4) else round(lat, 4) end as lat from m""")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    merged = upsert.upsert(_current(df), _batch(df), now())
    return merged.select("source_key", "external_id", F.round("price", 4).alias("price"), "street", "change", "status", F.round("lat", 4).alias("lat"))


@query("upsert_price_changes", f"{_UPSERT} select source_key, cast(id as string) as external_id, round(new_price, 4) as price from m where there and new_price is not null and (not here or abs(new_price - price) > {C.PRICE_CHANGE})")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return upsert.price_changes(upsert.upsert(_current(df), _batch(df), now()), now()).select("source_key", "external_id", F.round("price", 4).alias("price"))


@query("mark_missing", f"{W}, g as (select id, row_number() over (partition by source_key order by first_seen, id) as n from listings where source_key in ('src1', 'src2') and status = 'aktywna' and first_seen < {_NOW} - interval 3 day) select l.id, case when g.n <= 1000 then 'nieaktywna' else status end as status from listings l left join g on g.id = l.id")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("last_seen", F.col("first_seen"))
    return upsert.mark_missing(df, now(), ["src1", "src2"]).select("id", "status")


@query("mark_concluded", f"{W}select id, case when status = 'aktywna' and kind in ('licytacja', 'przetarg') and event_date < timestamp '2001-07-31 14:00:00' then 'nieaktywna' else status end as status from listings")
def _(spark, sf_dir):
    return upsert.mark_concluded(listings(spark, sf_dir), now()).select("id", "status")


@query("delete_listings", f"{W}, gone as (select id from listings where id % 16 = 0) select id, is_original or coalesce(duplicate_of_id in (select id from gone), false) as is_original, case when duplicate_of_id in (select id from gone) then null else duplicate_of_id end as duplicate_of_id from listings where id % 16 <> 0")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return upsert.delete(df, df.where("id % 16 = 0")).select("id", "is_original", "duplicate_of_id")


@query("retention", f"{W}select id from listings where status <> 'aktywna' and first_seen < {_NOW} - interval 540 day")
def _(spark, sf_dir):
    return upsert.expired(listings(spark, sf_dir).withColumn("last_seen", F.col("first_seen")), now()).select("id")


@query("detail_merge", f"{W}select id, coalesce(street, 'ul. Z opisu') as street, coalesce(floor, 1) as floor from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return upsert.fill_empty(df, df.select("id", F.lit("ul. Z opisu").alias("street"), F.lit(1).cast("long").alias("floor"))).select("id", "street", "floor")


@query("repair_prices", f"{W}select id, case when id % 9 = 0 or id % 9 = 1 then null else price end as price from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("price", F.when(F.col("id") % 9 == 0, 0.0).when(F.col("id") % 9 == 1, 11111111.0).otherwise(F.col("price")))
    return repair.prices(df).select("id", "price")


@query("repair_rates", f"{W}select id, case when price / area >= 1 then floor(price / area * 100 + 0.5) / 100 else nullif(floor(price / area * 10000 + 0.5) / 10000, 0) end as price_per_m2 from listings")
def _(spark, sf_dir):
    return repair.rates(listings(spark, sf_dir)).select("id", "price_per_m2")


@query("repair_land_area", f"{W}select id, case when property_type = 'garaz' then greatest(area, id % 300) else area end as area, case when property_type = 'garaz' then greatest(area, id % 300) else cast(id % 300 as double) end as plot_area from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("plot_area", (F.col("id") % 300).cast("double")).withColumn("property_type", F.when(F.col("property_type") == "garaz", "dzialka").otherwise(F.col("property_type")))
    return repair.land_area(df).select("id", "area", "plot_area")


@query("repair_navigation", f"{W}select id, case when status = 'aktywna' and id % 13 = 0 then 'archiwalna' else status end as status from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("title", F.when(F.col("id") % 13 == 0, "Polecane nieruchomości").otherwise(F.col("title")))
    return repair.navigation(df).select("id", "status")


@query("repair_points", f"{W}select id, case when lat between 48.9 and 55.05 and lon between 13.9 and 24.25 and lon between 14 and 20 then round(lat, 4) end as lat from (select id, lat, lon + case when id % 17 = 0 then 30 else 0 end as lon from listings)")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("lat", F.col("lat").cast("double")).withColumn("lon", (F.col("lon") + F.when(F.col("id") % 17 == 0, 30).otherwise(0)).cast("double"))
    regions = df.select("voivodeship").distinct().select("voivodeship", F.lit(40.0).alias("lat_min"), F.lit(60.0).alias("lat_max"), F.lit(14.0).alias("lon_min"), F.lit(20.0).alias("lon_max"))
    return repair.outside_region(repair.outside(df), regions).select("id", F.round("lat", 4).alias("lat"))


@query("repair_unswap", "select o_orderkey, case when swapped > timestamp '2001-08-01 12:00:00' and day(swapped) <= 12 then o_orderdate else swapped end as published from (select o_orderkey, o_orderdate, case when day(o_orderdate) <= 12 then make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) else o_orderdate end as swapped from orders)")
def _(spark, sf_dir):
    swapped = F.when(F.day("o_orderdate") <= 12, F.expr("make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)")).otherwise(F.col("o_orderdate").cast("timestamp"))
    return repair.unswap(table(spark, sf_dir, "orders").select("o_orderkey", swapped.alias("published")), now()).select("o_orderkey", "published")


_LIMITS = " ".join(f"when '{k}' then area between {low} and {high}" for k, (low, high) in C.AREA_LIMITS.items())


@query("repair_all_passes", f"""{W}, a as (select *, coalesce(case property_type {_LIMITS} end, true) as fits from listings),
r as (select *, case when fits then case when price / area >= 1 then floor(price / area * 100 + 0.5) / 100 else nullif(floor(price / area * 10000 + 0.5) / 10000, 0) end end as rate from a)
select cast(0 as bigint) as price, count(*) filter (area is not null and not fits) as area, count(*) filter (rate is distinct from price_per_m2) as price_per_m2, cast(0 as bigint) as status, count(*) filter (title is null) as title, count(*) filter (not (lat between 48.9 and 55.05 and lon between 13.9 and 24.25)) as lat from r""")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    return repair.change_counts(df, ["price", "area", "price_per_m2", "status", "title", "lat"])


@query("geocode_cache", f"{W}select id, round(case when id % 4 = 0 then case when street is not null then 50.0 + length(street) / 100.0 end else lat end, 4) as lat from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("lat", F.when(F.col("id") % 4 != 0, F.col("lat").cast("double"))).withColumn("lon", F.col("lon").cast("double"))
    key = text.digest(text.norm_key(F.concat_ws(", ", "street", "city", "voivodeship")))
    cache = df.where("street is not null").select(key.alias("query_hash"), (50.0 + F.length("street") / 100.0).alias("lat"), F.lit(20.0).alias("lon")).distinct()
    return places.geocode(df, cache)[0].select("id", F.round("lat", 4).alias("lat"))


@query("geocode_missing", f"{W}select street, city, count(*) as listings from listings where id % 5 = 0 and street is null group by all")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("lat", F.when(F.col("id") % 5 != 0, F.col("lat").cast("double"))).withColumn("lon", F.col("lon").cast("double"))
    key = text.digest(text.norm_key(F.concat_ws(", ", "street", "city", "voivodeship")))
    cache = df.where("street is not null").select(key.alias("query_hash"), F.lit(50.0).alias("lat"), F.lit(20.0).alias("lon")).distinct()
    return places.geocode(df, cache)[1].select("street", "city", "listings")


def _offers(df: DataFrame) -> DataFrame:
    """Listings of which some repeat others on a second portal."""
    rows = df.select("id", "source_key", "kind", "transaction", "property_type", F.concat(F.col("title"), F.lit(" numer "), (F.col("id") % 977).cast("string")).alias("title"), "city", "street", "area", F.col("rooms").cast("int").alias("rooms"), F.col("floor").cast("int").alias("floor"), "price", "seller_type", F.col("first_seen"), F.when(F.col("id") % 5 == 0, F.col("phone")).alias("phone_fingerprint"))
    again = rows.where("id % 6 = 0").withColumns({"id": F.col("id") + 10_000_000, "source_key": F.lit("mirror"), "price": F.col("price") * 1.02, "first_seen": F.col("first_seen") + F.expr("interval 1 day")})
    return duplicates.fingerprints(rows.unionByName(again))


@query("dedup_links")
def _(spark, sf_dir):
    return duplicates.links(saved(_offers(listings(spark, sf_dir))), saved)


@query("dedup_components")
def _(spark, sf_dir):
    rows = saved(_offers(listings(spark, sf_dir)))
    links = saved(duplicates.links(rows, saved))
    return duplicates.groups(rows, links, saved).select("id", "is_original", "duplicate_of_id", "copies_count")


@query("dedup_strict")
def _(spark, sf_dir):
    rows = saved(_offers(listings(spark, sf_dir)))
    links = saved(duplicates.links(rows, saved))
    return duplicates.strict_groups(rows, links, saved).select("id", "is_original", "duplicate_of_id", "copies_count", "method", "score")


@query("public_export", f"{W}select id, price, city, case when length(phone) = 9 then substr(phone, 1, 3) || ' *** ***' end as phone from listings where is_original and status = 'aktywna'")
def _(spark, sf_dir):
    found = search.search(listings(spark, sf_dir), Filters(), NOW)
    return export.public(found.select("id", "price", "city", "phone"))


@query("sitemap_xml", f"{W}select id, '<url><loc>https://example.org/oferta/' || cast(id as string) || '</loc><lastmod>' || strftime(listed_at, '%Y-%m-%d') || '</lastmod></url>' as xml from listings where is_original and status = 'aktywna'")
def _(spark, sf_dir):
    return export.sitemap(search.search(listings(spark, sf_dir), Filters(), NOW), "https://example.org/")
