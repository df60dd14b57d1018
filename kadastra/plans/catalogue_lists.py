"""Registered queries: lists of agencies and of details to read, contacts, records, labels, archiving, points to be asked anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import text
from kadastra.operators import agencies, places, repair, search, upsert
from kadastra.plans.views import LISTINGS_SQL, NOW, listings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = f"with {LISTINGS_SQL}\n"


def query(name: str, sql_text: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql_text
        return f

    return add


@query("browse_sales", f"{W}select id, price, city from listings where is_original and status = 'aktywna' and transaction = 'sprzedaz' and area >= 50")
def _(spark, sf_dir):
    """Without a transaction in the query, sales are browsed."""
    return search.search(listings(spark, sf_dir), search.browsing({"area_min": "50"}), NOW).select("id", "price", "city")


@query("browse_all", f"{W}select transaction, count(*) as n from listings where is_original and status = 'aktywna' group by transaction")
def _(spark, sf_dir):
    """An empty choice asks for all."""
    return search.search(listings(spark, sf_dir), search.browsing({"transaction": ""}), NOW).groupBy("transaction").agg(F.count("*").alias("n"))


_AGENCIES = "select s_suppkey as id, s_name as name, n_name as city, r_name as voivodeship, s_suppkey % 50 as listings, case when s_suppkey % 3 <> 0 then s_suppkey % 7 end as expected from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return joined.selectExpr("s_suppkey as id", "s_name as name", "n_name as city", "r_name as voivodeship", "s_suppkey % 50 as listings", "case when s_suppkey % 3 <> 0 then s_suppkey % 7 end as expected")


@query("agency_list", f"select id, name, listings, expected from ({_AGENCIES}) where contains(lower(city), 'tion_1') and listings > 0 order by listings desc nulls last, expected desc nulls last, name, id limit 100")
def _(spark, sf_dir):
    return agencies.listed(_agencies(spark, sf_dir), city=" tION_1 ", with_offers=True).select("id", "name", "listings", "expected")


@query("agency_list_second_page", f"select id, name, listings from ({_AGENCIES}) order by listings desc nulls last, expected desc nulls last, name, id limit 25 offset 25")
def _(spark, sf_dir):
    return agencies.listed(_agencies(spark, sf_dir), page=2, per_page=25).select("id", "name", "listings")


@query("contacts_batched", f"{W}select l.id, s_name as agency_name, coalesce(case when phone is not null then 'a' || phone || ',b' || phone end, '') as phones from listings l left join supplier on s_suppkey = agency_id")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    numbers = df.where("phone is not null").select(F.col("id").alias("listing_id"), F.explode(F.array(F.concat(F.lit("b"), "phone"), F.concat(F.lit("a"), "phone"), F.concat(F.lit("a"), "phone"))).alias("masked"))
    found = search.with_contacts(df.select("id", "agency_id"), numbers, _agencies(spark, sf_dir))
    return found.select("id", "agency_name", F.array_join("phones", ",").alias("phones"))


@query("nested_records", f"{W}select id, price, city, lat, seller_type, agency_id, case when kind in ('licytacja', 'przetarg', 'wykaz') then event_date end as event_date, kind in ('licytacja', 'przetarg', 'wykaz') as has_auction, case when id % 4 <> 0 then (id % 100) / 100.0 end as ratio, case when id % 4 <> 0 then cast(100 - id % 100 as double) end as below_percent from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"deal_ratio": F.expr("case when id % 4 <> 0 then id % 100 / 100.0D end"), "deal_level": F.lit("miasto")})
    r = search.records(df)
    return r.select("id", "price", "location.city", "location.lat", "seller.seller_type", "seller.agency_id", "auction.event_date", F.col("auction").isNotNull().alias("has_auction"), F.col("deal.ratio").alias("ratio"), F.col("deal.below_percent").alias("below_percent"))


@query("detail_queue", f"{W}select id, property_type from listings order by case when property_type in ('mieszkanie', 'dom') then 0 else 1 end, first_seen desc nulls last, id desc limit 200")
def _(spark, sf_dir):
    return search.detail_queue(listings(spark, sf_dir), 200).select("id", "property_type")


@query("archive_old", f"{W}select id, case when status = 'nieaktywna' and first_seen < timestamp '{NOW}' - interval {C.RETENTION_DAYS} day then 'archiwalna' else status end as status from listings")
def _(spark, sf_dir):
    return upsert.archive(listings(spark, sf_dir).withColumn("last_seen", F.col("first_seen")), F.lit(NOW).cast("timestamp")).select("id", "status")


_PORTAL = "case when id % 4 = 0 then 'portal' else geo_precision end"


@query("stale_points", f"""{W}, p as (select *, {_PORTAL} as told, min(lat) over (partition by street, city, voivodeship) as c_lat, min(lon) over (partition by street, city, voivodeship) as c_lon from listings)
select id, case when told <> 'portal' and (abs(lat - c_lat) > {C.STALE_POINT} or abs(lon - c_lon) > {C.STALE_POINT}) then c_lat else lat end as lat, case when told <> 'portal' and (abs(lat - c_lat) > {C.STALE_POINT} or abs(lon - c_lon) > {C.STALE_POINT}) then c_lon else lon end as lon from p""")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    cache = df.groupBy(text.digest(text.norm_key(F.concat_ws(", ", "street", "city", "voivodeship"))).alias("query_hash")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return repair.stale_points(df.withColumn("geo_precision", F.expr(_PORTAL)), cache).select("id", "lat", "lon")


_ASKED = "concat_ws(', ', street, city)"


@query("points_to_ask_anew", f"{W}select id, case when street is null or geo_precision <> 'city' then lat end as lat, case when street is null or geo_precision <> 'city' then geo_precision end as geo_precision from listings")
def _(spark, sf_dir):
    return places.invalidate(listings(spark, sf_dir), _cache(spark, sf_dir))[0].select("id", "lat", "geo_precision")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy(F.expr(_ASKED).alias("query")).agg(F.min("geo_precision").alias("precision"))


@query("cache_that_stays", f"{W}, c as (select {_ASKED} as query, min(geo_precision) as precision from listings group by 1) select * from c where not (precision = 'city' and contains(query, ','))")
def _(spark, sf_dir):
    return places.invalidate(listings(spark, sf_dir), _cache(spark, sf_dir))[1]


@query("unescaped_texts", "select doc_id, sha256(text || ' <b> & ó \"') as digest from documents where text is not null")
def _(spark, sf_dir):
    """Texts that were encoded twice, beside references with names and numbers."""
    once = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    twice = once(F.concat(once(F.col("text")), F.lit(" &lt;b&gt; &amp; &oacute; &#34;")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.unescape(twice), 256).alias("digest"))


@query("short_labels", f"{W}select id, case when length(title) <= 24 then title else regexp_replace(substr(title, 1, 23), '[ ,-]+$', '') || '…' end as label, case when id % 3 = 0 then 'Portal' else replace(source_key || '_' || city, '_', ' ') end as source from listings")
def _(spark, sf_dir):
    """Listings without a title have no label, those without a town no key to be named by."""
    name, key = F.expr("case when id % 3 = 0 then 'Portal — oferty' when id % 3 = 1 then '' end"), F.concat("source_key", F.lit("_"), "city")
    label = F.when(F.col("title").isNotNull(), text.short_label(F.col("title"), 24))
    source = F.when((F.col("id") % 3 == 0) | key.isNotNull(), text.source_label(name, key))
    return listings(spark, sf_dir).select("id", label.alias("label"), source.alias("source"))
