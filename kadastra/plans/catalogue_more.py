"""Registered queries: registries, logs, agencies, crawling, SQL functions, the rest of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.functions import numbers, sql, text
from kadastra.operators import agencies, alerts, duplicates, places, search, stats, upsert
from kadastra.operators.search import Filters
from kadastra.plans.catalogue_data import key_sql
from kadastra.plans.catalogue_search import _KM
from kadastra.plans.views import LISTINGS_SQL, NOW, listings, table
from kadastra.sources import export, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = f"with {LISTINGS_SQL}\n"


def query(name: str, sql_text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql_text is not None:
            ORACLE_SQL[name] = sql_text
        return f

    return add


@query("sql_functions", f"select doc_id, {key_sql('text')} as k, coalesce(nullif(substr({key_sql('text', '-')}, 1, 150), ''), 'brak') as s from documents")
def _(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_query")
    return spark.sql("select doc_id, norm_key(text) as k, slug(text) as s from documents_of_query")


@query("search_total", f"{W}select id, price, count(*) over () as total from listings where is_original and status = 'aktywna' and property_type = 'dom' order by price desc nulls last, id desc limit 25")
def _(spark, sf_dir):
    df, f = listings(spark, sf_dir), Filters(property_type="dom", sort="cena_malejaco")
    total = search.search(df, f, NOW).count()
    return search.page(df, f, NOW).select("id", "price", F.lit(total).cast("long").alias("total"))


@query("scan_totals", "select cast(sum(l_linenumber) as bigint) as found, cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as bigint) as new, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as updated, cast(sum(case when l_tax = 0 then 1 else 0 end) as bigint) as errors from lineitem")
def _(spark, sf_dir):
    one = lambda c: F.when(c, 1).otherwise(0)
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("found"), one(F.col("l_returnflag") == "A").alias("new"), one(F.col("l_returnflag") == "R").alias("updated"), one(F.col("l_tax") == 0).alias("errors"))
    return stats.scan_totals(runs)


@query("surroundings", f"{W}, a as (select * from listings where kind = 'licytacja' and status = 'aktywna'), b as (select * from listings where kind in ('przetarg', 'wykaz') and status = 'aktywna'), p as (select a.id as a_id, b.id as b_id, b.property_type as label, {_KM} as km from a, b where {_KM} <= 8), r as (select *, row_number() over (partition by a_id order by km, b_id) as n from p) select a_id, label, round(min(km), 3) as km from r where n <= 120 group by all")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).where("status = 'aktywna'")
    near = places.surroundings(df.where("kind = 'licytacja'"), df.where("kind in ('przetarg', 'wykaz')").select("id", "lat", "lon", F.col("property_type").alias("label")), 8.0)
    return near.withColumn("km", F.round("km", 3))


@query("units_by_code", "select c_custkey, n.n_name as unit_name from customer join nation n on n_nationkey = c_nationkey")
def _(spark, sf_dir):
    units = table(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") + 10).cast("string"), 2, "0").alias("teryt"), F.col("n_name").alias("name"), F.lit("w").alias("voivodeship"))
    coded = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lpad((F.col("c_nationkey") + 10).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") % 90000 + 10000).cast("string"), 5, "0")).alias("teryt"))
    return places.by_code(coded, units).select("c_custkey", "unit_name")


@query("resolve_places", f"{W}select id, city as place, city as found from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    units = df.select(F.col("city").alias("name"), "voivodeship", "county").distinct().select(F.col("name").alias("teryt"), "name", F.lit("gmina").alias("kind"), "voivodeship", "county", F.lit(False).alias("town"), F.lit(False).alias("city_county"))
    asked = df.select("id", F.col("city").alias("place"), F.col("voivodeship").alias("hint"))
    return places.resolve(asked, units).select("id", "place", F.col("teryt").alias("found"))


@query("alerts_untold", f"{W}, m as (select id from listings where is_original and status = 'aktywna' and property_type = 'mieszkanie' and price <= 100000 order by listed_at desc nulls last, id desc limit 50) select 1 as search_id, id, c as channel from m, (values ('mail'), ('telegram')) t(c) where not (c = 'mail' and id % 3 = 0)")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    channels = spark.createDataFrame([(1, "mail"), (1, "telegram")], "search_id int, channel string")
    log = df.where("id % 3 = 0").select(F.lit(1).alias("search_id"), "id", F.lit("mail").alias("channel"))
    return alerts.untold(alerts.matches(df, {1: Filters(property_type="mieszkanie", price_max=100000.0)}, NOW), channels, log)


@query("alert_messages", f"{W}select id, concat_ws(' · ', title, format('{{:,}}', cast(round_even(price, 0) as bigint)) || ' zł', format('{{:,.1f}}', cast(area as double)) || ' m²', concat_ws(', ', street, city)) as message from listings where kind = 'licytacja' and is_original and status = 'aktywna' order by listed_at desc nulls last, id desc limit 25")
def _(spark, sf_dir):
    return alerts.message(search.page(listings(spark, sf_dir), Filters(kind="licytacja"), NOW))


@query("agency_merge", "select 's' || cast(s_suppkey as string) as slug, case when s_suppkey % 2 = 0 then upper(s_name) else s_name end as name, s_suppkey % 2 = 0 as verified, case when s_suppkey % 2 = 0 then 3 else 2 end as phones from supplier where s_suppkey % 3 <> 2 or s_suppkey % 2 = 0")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    slug = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug")
    known = s.where("s_suppkey % 3 <> 2").select(slug, F.col("s_name").alias("name"), F.lit("c").alias("city"), F.lit(1).alias("expected"), F.array(F.lit("1"), F.lit("2")).alias("phones"), F.lit(False).alias("verified"))
    catalogue = s.where("s_suppkey % 2 = 0").select(slug, F.upper("s_name").alias("name"), F.lit(None).cast("string").alias("city"), F.lit(5).alias("expected"), F.when(F.col("s_suppkey") % 3 == 2, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).otherwise(F.array(F.lit("3"), F.lit("2"))).alias("phones"))
    return agencies.merge_catalogue(known, catalogue).select("slug", "name", "verified", F.size("phones").alias("phones"))


@query("agency_networks", "select s_suppkey as id, case when s_suppkey % 10 = 1 then 'Sieć Jeden' when s_suppkey % 10 = 2 then 'Sieć Dwa' end as network from supplier")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("case when s_suppkey % 10 = 1 then 'Biuro SIEC jeden Opole' when s_suppkey % 10 = 2 then 'Dwójka - partner' else s_name end").alias("name"))
    return agencies.networks(names, {"Sieć Jeden": [], "Sieć Dwa": ["dwójka"]}).select("id", "network")


@query("registry_sync", "select coalesce(s.k, f.k) as key, coalesce(f.n, s.n) as name, f.k is not null and f.on_ as enabled from (select 'k' || cast(s_suppkey as string) as k, s_name as n from supplier where s_suppkey % 2 = 0) s full join (select 'k' || cast(s_suppkey as string) as k, upper(s_name) as n, s_suppkey % 9 <> 0 as on_ from supplier where s_suppkey % 3 = 0) f on s.k = f.k")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key")
    known = s.where("s_suppkey % 2 = 0").select(key, F.col("s_name").alias("name"), F.lit("x").alias("scraper"), F.lit(True).alias("enabled"))
    file = s.where("s_suppkey % 3 = 0").select(key, F.upper("s_name").alias("name"), F.lit("y").alias("scraper"), (F.col("s_suppkey") % 9 != 0).alias("enabled"))
    return export.sync_registry(known, file).select("key", "name", "enabled")


@query("phone_sync", f"{W}select id as listing_id, phone as hashed from listings where phone is not null union select id, phone || 'x' from listings where phone is not null and id % 2 = 0")
def _(spark, sf_dir):
    known = listings(spark, sf_dir).where("phone is not null").select(F.col("id").alias("listing_id"), F.col("phone").alias("hashed"))
    found = known.unionByName(known.where("listing_id % 2 = 0").withColumn("hashed", F.concat("hashed", F.lit("x"))))
    return upsert.sync_phones(known, found)


@query("crawl_first_seen", "select user_id, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by user_id")
def _(spark, sf_dir):
    return duplicates.first_of(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "ts", "event_id")


@query("crawl_pages", """with p as (select 'u' || cast(user_id % 5 as string) as section, event_id // 100 as page, event_id as position, (event_id * 7919) % 20011 as item from events),
f as (select *, row_number() over (partition by item order by page, section, position) = 1 as fresh from p), e as (select section, min(page) as e from (select section, page, max(fresh) as any_fresh from f group by all) where not any_fresh group by section)
select f.section, page, item from f left join e on e.section = f.section where fresh and (e is null or page < e)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr("'u' || cast(user_id % 5 as string)").alias("section"), F.expr("event_id div 100").alias("page"), F.col("event_id").alias("position"), F.expr("(event_id * 7919) % 20011").alias("item"))
    return pages.crawl_order(rows, "item").select("section", "page", "item")


@query("street_from_text", f"{W}select id, case id % 4 when 0 then 'Leona Powolnego' when 1 then 'Jana Pawła II' when 2 then '3 Maja' end as street from listings")
def _(spark, sf_dir):
    told = F.expr("case id % 4 when 0 then 'Mieszkanie przy ul. Leona Powolnego. Kontakt 537 214 908.' when 1 then 'Lokal, al. Jana Pawła II, parter' when 2 then 'dom na ulicy 3 Maja' else 'bez adresu' end")
    return listings(spark, sf_dir).select("id", text.extract_street(told).alias("street"))


@query("amounts_from_text", f"{W}select id, cast(1000 + id % 900 as double) * 1000 as amount, cast(id % 99999 as string) as parcel from listings")
def _(spark, sf_dir):
    told = F.concat(F.lit("wpłata 500 zł, cena "), F.regexp_replace(F.format_number((1000 + F.col("id") % 900) * 1000, 0), ",", " "), F.lit(" zł, działka nr "), (F.col("id") % 99999).cast("string"))
    return listings(spark, sf_dir).select("id", numbers.price_from_text(told).alias("amount"), F.get(numbers.parcel_numbers(told), 0).alias("parcel"))


@query("sitemap_read", f"{W}select 'https://e.org/' || cast(id as string) as url, case when id % 3 <> 0 then listed_at end as lastmod from listings")
def _(spark, sf_dir):
    xml = F.concat(F.lit("<urlset><url><loc>https://e.org/"), F.col("id").cast("string"), F.lit("</loc>"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("<lastmod>"), F.date_format("listed_at", "yyyy-MM-dd"), F.lit("T00:00:00Z</lastmod>"))).otherwise(""), F.lit("</url></urlset>"))
    return pages.sitemap_urls(listings(spark, sf_dir).select(xml.alias("xml"))).select("url", "lastmod")


@query("similar_pool", f"""{W}, c as (select a.id as a_id, b.id as id, case when a.city = b.city then 0 when a.county = b.county then 1 else 2 end as level, abs(b.price - a.price) / a.price + coalesce(abs(coalesce(b.area, 0) - a.area) / a.area, 0) as gap
from (select * from listings where status = 'aktywna' and is_original and id % 20 = 0) a join (select * from listings where is_original and status = 'aktywna') b on a.kind = b.kind and a.property_type = b.property_type and a.transaction = b.transaction and a.voivodeship = b.voivodeship and a.id <> b.id
where b.price between a.price * 0.75 and a.price * 1.3 and (a.area is null or b.area between a.area * 0.75 and a.area * 1.3) and (a.property_type not in ('mieszkanie', 'dom') or a.rooms is null or b.rooms is null or abs(a.rooms - b.rooms) <= 1)),
r as (select *, row_number() over (partition by a_id, level order by gap, id) as n from c) select a_id, id, level from r where n <= 300""")
def _(spark, sf_dir):
    from kadastra.operators import similar

    df = listings(spark, sf_dir)
    return similar.pools(df, df.where("status = 'aktywna' and is_original and id % 20 = 0")).select("a_id", "id", "level")


@query("price_cheapest_by_town", f"{W}select city, id, price from (select *, row_number() over (partition by city order by price, id) as n from listings where status = 'aktywna') where n = 1")
def _(spark, sf_dir):
    w = Window.partitionBy("city").orderBy("price", "id")
    return listings(spark, sf_dir).where("status = 'aktywna'").withColumn("n", F.row_number().over(w)).where("n = 1").select("city", "id", "price")
