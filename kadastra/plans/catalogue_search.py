"""Registered queries: search, statistics, market, places, similar offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import geo, text
from kadastra.functions.text import ACCENTED, PLAIN
from kadastra.operators import agencies, duplicates, market, places, search, similar, stats
from kadastra.operators.search import Filters
from kadastra.plans.views import LISTINGS_SQL, NOW, listings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def fold_sql(x: str) -> str:
    return f"lower(translate({x}, '{ACCENTED}', '{PLAIN}'))"


W = f"with {LISTINGS_SQL}\n"
SHOWN = ("id", "price", "area", "city", "listed_at")
_BASE = "is_original and status = 'aktywna'"


def _search(name: str, f: Filters, where: str, order: str = "listed_at desc nulls last, id desc", limit: int | None = None, offset: int = 0) -> None:
    tail = "" if limit is None else f" order by {order} limit {limit} offset {offset}"

    def run(spark, sf_dir):
        df = listings(spark, sf_dir)
        found = search.search(df, f, NOW) if limit is None else search.page(df, f, NOW)
        return found.select(*SHOWN)

    query(name, f"{W}select {', '.join(SHOWN)} from listings where {where}{tail}")(run)


_search("search_basic", Filters(property_type="mieszkanie", transaction="sprzedaz", price_max=200000.0), f"{_BASE} and property_type = 'mieszkanie' and transaction = 'sprzedaz' and price <= 200000", limit=25)
_search("search_ranges", Filters(price_min=50000.0, price_max=300000.0, area_min=40.0, area_max=160.0, rooms_min=2, rooms_max=5, floor_min=1, floor_max=8, price_m2_min=500.0, only_original=False, only_active=False), "price between 50000 and 300000 and area between 40 and 160 and rooms between 2 and 5 and floor between 1 and 8 and price_per_m2 >= 500")
_search("search_sort_nulls_last", Filters(sort="cena_m2_rosnaco", per_page=100, only_active=False, page=3), "is_original", "price_per_m2 asc nulls last, id desc", 100, 200)
_search("search_page_two", Filters(sort="powierzchnia", page=2), _BASE, "area desc nulls last, id desc", 25, 25)
_search("search_auction_dates", Filters(kind="licytacja", sort="termin_licytacji", per_page=100, only_active=False), "is_original and kind = 'licytacja'", f"case when event_date < timestamp '2001-08-01 14:00:00' then 1 else 0 end, event_date asc nulls last, id desc", 100)
_search("search_place_prefix", Filters(city="nation_1"), f"{_BASE} and {fold_sql('city')} like 'nation\\_1%' escape '\\'")
_search("search_fold_prefix", Filters(district="srodm"), f"{_BASE} and {fold_sql('district')} like 'srodm%'")
_search("search_voivodeship_source", Filters(voivodeship="EUROPE", source=("src1", "src4")), "status = 'aktywna' and voivodeship = 'EUROPE' and source_key in ('src1', 'src4')")
_search("search_street_terms", Filters(street="ul. Pawła Jana 7"), f"{_BASE} and contains({fold_sql('street')}, 'pawl') and contains({fold_sql('street')}, 'jan')")
_search("search_fulltext", Filters(q="Miłosza"), f"{_BASE} and (contains({fold_sql('title')}, 'milosza') or contains({fold_sql('street')}, 'milosza'))")
_search("search_literal_percent", Filters(q="100%_x", only_active=False), f"is_original and (contains({fold_sql('title')}, '100%_x') or contains({fold_sql('street')}, '100%_x'))")
_search("search_with_phone", Filters(with_phone=True, seller_type="prywatna"), f"{_BASE} and phone is not null and seller_type = 'prywatna'")
_search("search_unknown_enum", Filters(kind="zamek", agency_id=7), f"{_BASE} and agency_id = 7")
_search("price_dropped", Filters(price_dropped=True), f"{_BASE} and price < initial_price")
_search("days_on_market", Filters(days_on_market_min=30, days_on_market_max=365), f"{_BASE} and listed_at <= timestamp '{NOW}' - interval 30 day and listed_at >= timestamp '{NOW}' - interval 365 day")
_search("search_period_today", Filters(period="dzis", only_active=False, only_original=False), "listed_at >= timestamp '2001-07-31 22:00:00'")
_search("search_period_month", Filters(period="30dni"), f"{_BASE} and listed_at >= timestamp '{NOW}' - interval 30 day")


@query("phone_lookup", f"{W}select id, phone as national, listed_at from listings where phone like '%1234%' order by listed_at desc nulls last, id desc limit 100")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    phones = df.where("phone is not null").select(F.col("id").alias("listing_id"), F.col("phone").alias("national"))
    return search.phone_lookup(df, phones, "12-34").select("id", "national", "listed_at")


@query("with_phone_semi", f"{W}select id from listings l where exists (select 1 from listings p where p.id = l.id and p.phone is not null)")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.join(df.where("phone is not null").select("id"), "id", "left_semi").select("id")


@query("no_phone_anti", f"{W}select id from listings where phone is null")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.join(df.where("phone is not null").select("id"), "id", "left_anti").select("id")


_ACTIVE = "status = 'aktywna'"
_FLATS = f"{_BASE} and property_type = 'mieszkanie' and transaction = 'sprzedaz'"


@query("stats_totals", f"""{W}select count(*) as listings, count(*) filter (where {_ACTIVE}) as active, count(*) filter (where {_BASE}) as originals, count(*) filter (where {_ACTIVE} and not is_original) as copies,
count(*) filter (where {_ACTIVE} and kind = 'licytacja') as auctions, count(*) filter (where {_ACTIVE} and kind in ('przetarg', 'wykaz')) as tenders,
count(*) filter (where {_ACTIVE} and listed_at >= timestamp '{NOW}' - interval 7 day) as this_week, count(*) filter (where {_BASE} and price < initial_price) as dropped,
count(*) filter (where {_ACTIVE} and seller_type = 'prywatna') as private, count(*) filter (where {_ACTIVE} and phone is not null) as with_phone, count(*) filter (where {_ACTIVE} and lat is not null) as with_point,
round(avg(case when {_FLATS} then price_per_m2 end), 0) as avg_price_m2 from listings""")
def _(spark, sf_dir):
    return stats.totals(listings(spark, sf_dir), NOW)


for _column, _most in (("kind", None), ("source_key", None), ("seller_type", None), ("geo_precision", None), ("city", 12)):
    _tail = "" if _most is None else f" order by n desc, {_column} limit {_most}"
    query(f"stats_by_{_column}", f"{W}select {_column}, count(*) as n from listings where {_ACTIVE} and {_column} is not null group by {_column}{_tail}")(lambda spark, sf_dir, c=_column, m=_most: stats.counts(listings(spark, sf_dir), c, m))


@query("market_report", f"""{W}, r as (select *, row_number() over (partition by property_type order by price) as place, count(*) over (partition by property_type) as group_n,
greatest(0, floor((epoch_us(timestamp '{NOW}') - epoch_us(listed_at)) / 86400000000)) as days from listings where is_original and price is not null and listed_at >= timestamp '{NOW}' - interval 900 day)
select property_type, count(*) as n, max(case when place = group_n // 2 + 1 then price end) as median_price, min(price) as min_price, max(price) as max_price, round(avg(price), 2) as avg_price,
round(avg(days), 1) as avg_days, count(*) filter (where status <> 'aktywna') as removed, round(100.0 * count(*) filter (where seller_type = 'posrednik') / count(*), 1) as agency_share from r group by property_type""")
def _(spark, sf_dir):
    return stats.market_report(listings(spark, sf_dir), NOW, 900)


_TYPES = ", ".join(f"'{t}'" for t in C.COMPARABLE_TYPES)
_COMPARABLE = f"{_ACTIVE} and price_per_m2 > 0 and property_type in ({_TYPES})"
_KEYS = "select 0 as rank, 'miasto' as level, city || '|' || voivodeship as scope, l.* from listings l union all select 1, 'powiat', county || '|' || voivodeship, l.* from listings l union all select 2, 'wojewodztwo', voivodeship, l.* from listings l"
_MEDIANS = f"{W}, keyed as (select * from ({_KEYS}) where {_COMPARABLE} and scope is not null), stats as (select level, scope, property_type, transaction, median(price_per_m2) as median, count(*) as n from keyed group by all having count(*) >= {C.MIN_SAMPLE})"


@query("market_medians", f"{_MEDIANS} select level, scope, property_type, transaction, round(median, 4) as median, n from stats")
def _(spark, sf_dir):
    return market.medians(listings(spark, sf_dir)).withColumn("median", F.round("median", 4))


_SCORED = f"""{_MEDIANS}, best as (select id, arg_min(s.level, rank) as level, arg_min(s.median, rank) as median from keyed k join stats s on s.level = k.level and s.scope = k.scope and s.property_type = k.property_type and s.transaction = k.transaction group by id),
scored as (select l.*, case when floor(price_per_m2 / median * 1000 + 0.5) / 1000 >= {C.MIN_RATIO} then floor(price_per_m2 / median * 1000 + 0.5) / 1000 end as deal_ratio, best.level as found_level from listings l left join best on best.id = l.id)"""


@query("deal_scores", f"{_SCORED} select id, deal_ratio, case when deal_ratio is not null then found_level end as deal_level from scored")
def _(spark, sf_dir):
    return market.score(listings(spark, sf_dir)).select("id", "deal_ratio", "deal_level")


@query("deal_list", f"{_SCORED} select id, price, deal_ratio, found_level as deal_level from scored where {_BASE} and deal_ratio <= {C.BARGAIN_RATIO} and found_level in ('miasto', 'powiat') and transaction = 'sprzedaz' order by deal_ratio, id desc limit 100")
def _(spark, sf_dir):
    f = Filters(deal_max=C.BARGAIN_RATIO, deal_level=("miasto", "powiat"), transaction="sprzedaz", sort="okazje", per_page=100)
    return search.page(market.score(listings(spark, sf_dir)), f, NOW).select("id", "price", "deal_ratio", "deal_level")


@query("bargain_count", f"{_SCORED} select count(*) filter (where {_BASE} and deal_ratio <= {C.BARGAIN_RATIO} and found_level in ('miasto', 'powiat')) as bargains from scored")
def _(spark, sf_dir):
    return market.score(listings(spark, sf_dir)).agg(F.count_if(market.is_bargain()).alias("bargains"))


@query("market_levels", f"{_MEDIANS} select level, scope, round(median, 4) as median, n from stats where property_type = 'mieszkanie' and transaction = 'sprzedaz' and ((level = 'miasto' and scope = 'NATION_1-1|' || (select max(voivodeship) from listings where county = 'NATION_1')) or (level = 'powiat' and scope = 'NATION_1|' || (select max(voivodeship) from listings where county = 'NATION_1')) or (level = 'wojewodztwo' and scope = (select max(voivodeship) from listings where county = 'NATION_1')))")
def _(spark, sf_dir):
    region = table(spark, sf_dir, "nation").where("n_name = 'NATION_1'").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name").first()
    return market.levels(market.medians(listings(spark, sf_dir)), "NATION_1-1", "NATION_1", region[0] if region else "", "mieszkanie", "sprzedaz").select("level", "scope", F.round("median", 4).alias("median"), "n")


@query("stale_scored_anti", f"{_SCORED} select id from scored where deal_ratio is not null and id not in (select id from scored where deal_ratio is not null and id % 10 <> 0)")
def _(spark, sf_dir):
    scored = market.score(listings(spark, sf_dir))
    return market.stale(scored, scored.where("id % 10 <> 0")).select("id")


@query("agency_counts", f"{W}select agency_id, count(*) as listings from listings where {_ACTIVE} and agency_id is not null group by agency_id")
def _(spark, sf_dir):
    return agencies.recount(listings(spark, sf_dir)).select("agency_id", "listings")


@query("agency_modal_city", f"{W}, c as (select agency_id, city, count(*) as c from listings where {_ACTIVE} and agency_id is not null group by all), r as (select *, row_number() over (partition by agency_id order by c desc, city) as r, lead(c) over (partition by agency_id order by c desc, city) as nxt from c) select agency_id, max(case when r = 1 and (nxt is null or c > nxt) then city end) as modal_city from r group by agency_id")
def _(spark, sf_dir):
    return agencies.recount(listings(spark, sf_dir)).select("agency_id", "modal_city")


@query("agency_coverage", f"{W}, c as (select agency_id, count(*) as listings from listings where {_ACTIVE} and agency_id is not null group by agency_id) select s_suppkey as id, cast(s_suppkey % 90 as bigint) as expected, coalesce(listings, 0) as listings, greatest(0, s_suppkey % 90 - coalesce(listings, 0)) as missing from supplier left join c on agency_id = s_suppkey")
def _(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).cast("long").alias("expected"))
    return agencies.coverage(known, agencies.recount(listings(spark, sf_dir)))


_LABEL = {"ul. Łódzka 12": "Łódzka", "al. Jana Pawła II": "Jana Pawła II", "Ozimskiej": "Ozimska", "Czesława Miłosza, Kleczków": "Czesława Miłosza", "os. Piastowska 3/5": "Piastowska"}
_CASE = "case street " + " ".join(f"when '{k}' then '{v}'" for k, v in _LABEL.items()) + " end"


@query("street_suggest", f"{W}select label, cast(sum(n) as bigint) as n from (select {_CASE} as label, count(*) as n from listings where street is not null group by street) group by label order by n desc, label limit 20")
def _(spark, sf_dir):
    return stats.street_suggest(listings(spark, sf_dir), "")


@query("sitemap_cities", f"{W}select city, voivodeship, count(*) as n from listings where {_ACTIVE} group by all having count(*) >= 3 order by n desc, city, voivodeship limit 3000")
def _(spark, sf_dir):
    return stats.sitemap_groups(listings(spark, sf_dir), ["city", "voivodeship"], 3000)


@query("sitemap_chunks", f"{W}select id, (row_number() over (order by id) - 1) // 1000 as chunk from listings where {_BASE}")
def _(spark, sf_dir):
    return stats.sitemap_chunks(search.search(listings(spark, sf_dir), Filters(), NOW), 1000)


@query("map_points", f"{W}select id, substr(title, 1, 110) as title, round(lat, 6) as lat, round(lon, 6) as lon, cast(greatest(0, floor((epoch_us(timestamp '{NOW}') - epoch_us(listed_at)) / 86400000000)) as bigint) as age_days, price from listings where {_BASE} order by listed_at desc nulls last, id desc limit 20000")
def _(spark, sf_dir):
    return search.map_points(search.search(listings(spark, sf_dir), Filters(), NOW), NOW)


_SPREAD = f"(case geo_precision when 'address' then 0.0 when 'city' then {C.JITTER_SPREAD} else {C.JITTER_SPREAD} / 4 end) * sqrt(((id * 31) % 100) / 100.0)"


@query("geojson_jitter", f"{W}select id, round(lat + {_SPREAD} * cos(radians((id * {C.JITTER_ANGLE}) % 360.0)), 7) as lat, round(lon + {_SPREAD} * sin(radians((id * {C.JITTER_ANGLE}) % 360.0)) * {C.JITTER_LON}, 7) as lon from listings")
def _(spark, sf_dir):
    lat, lon = geo.jitter(F.col("id"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("geo_precision"))
    return listings(spark, sf_dir).select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("geojson_features", f"""{W}select id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || cast(round(lon, 6) as varchar) || ',' || cast(round(lat, 6) as varchar) || ']}},"properties":{{"id":' || cast(id as varchar) || case when title is null then '' else ',"title":"' || title || '"' end || ',"price":' || cast(price as varchar) || '}}}}' as feature from listings""")
def _(spark, sf_dir):
    return search.geojson(listings(spark, sf_dir).select("id", "title", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "price"))


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("haversine_neighbours", f"{W}, a as (select * from listings where kind = 'licytacja' and {_ACTIVE}), b as (select * from listings where kind = 'przetarg' and {_ACTIVE}) select a.id as a_id, b.id as b_id, round({_KM}, 3) as km from a, b where {_KM} <= 5")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).where(_ACTIVE)
    found = places.neighbours(df.where("kind = 'licytacja'"), df.where("kind = 'przetarg'"), 5.0)
    return found.withColumn("km", F.round("km", 3))


@query("nearest_point", f"{W}, a as (select * from listings where kind = 'licytacja' and {_ACTIVE}), b as (select * from listings where kind = 'przetarg' and {_ACTIVE}), p as (select a.id as a_id, b.id as b_id, {_KM} as km from a, b) select a_id, arg_min(b_id, (km, b_id)) as b_id, round(min(km), 3) as km from p where km <= 5 group by a_id")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).where(_ACTIVE)
    return places.nearest(df.where("kind = 'licytacja'"), df.where("kind = 'przetarg'"), 5.0).select("a_id", "b_id", F.round("km", 3).alias("km"))


@query("nearest_rings", f"{W}, a as (select * from listings where kind = 'licytacja' and {_ACTIVE}), b as (select * from listings where kind = 'przetarg' and {_ACTIVE}), p as (select a.id as a_id, b.id as b_id, {_KM} as km from a, b) select a_id, arg_min(b_id, (km, b_id)) as b_id, round(min(km), 3) as km from p where km <= 5 group by a_id")
def _(spark, sf_dir):
    """The same by cells that grow until something is near."""
    from kadastra.operators import geocoder
    from kadastra.plans.catalogue_state import saved

    df = listings(spark, sf_dir).where(_ACTIVE)
    return geocoder.nearest(df.where("kind = 'licytacja'"), df.where("kind = 'przetarg'"), 5.0, saved).select("a_id", "b_id", F.round("km", 3).alias("km"))


_BOXES = [("zachód", 49.0, 55.0, 14.0, 17.0), ("środek", 49.0, 55.0, 17.0, 20.0), ("małe", 51.0, 52.0, 18.0, 19.0)]


@query("bbox_regions", f"{W}select id, case when lat between 51.0 and 52.0 and lon between 18.0 and 19.0 then 'małe' when lat between 49.0 and 55.0 and lon between 14.0 and 17.0 then 'zachód' when lat between 49.0 and 55.0 and lon between 17.0 and 20.0 then 'środek' end as box_region from listings")
def _(spark, sf_dir):
    boxes = spark.createDataFrame(_BOXES, "voivodeship string, lat_min double, lat_max double, lon_min double, lon_max double")
    return places.region_of_point(listings(spark, sf_dir), boxes).select("id", "box_region")


_ANCHORS = "status = 'aktywna' and is_original and id % 20 = 0"
_LO, _HI = C.SIMILAR_LOW, C.SIMILAR_HIGH


@query("similar_candidates", f"""{W}select a.id as a_id, b.id as id, case when a.city = b.city then 0 when a.county = b.county then 1 else 2 end as level from (select * from listings where {_ANCHORS}) a join (select * from listings where {_BASE}) b
on a.kind = b.kind and a.property_type = b.property_type and a.transaction = b.transaction and a.voivodeship = b.voivodeship and a.id <> b.id
where b.price between a.price * {_LO} and a.price * {_HI} and (a.area is null or b.area between a.area * {_LO} and a.area * {_HI}) and (a.property_type not in ('mieszkanie', 'dom') or a.rooms is null or b.rooms is null or abs(a.rooms - b.rooms) <= 1)""")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    return similar.candidates(df, df.where(_ANCHORS)).select("a_id", "id", "level")


@query("similar_offers")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    from kadastra.plans.catalogue_state import saved

    return similar.similar(df, saved(df.where(_ANCHORS)), saved).withColumn("closeness", F.round("closeness", 6))


@query("copies_join", f"{W}select c.duplicate_of_id as original_id, count(*) as copies from listings c join listings o on o.id = c.duplicate_of_id group by 1")
def _(spark, sf_dir):
    return duplicates.copies(listings(spark, sf_dir))


@query("dangling_links", f"{W}select id, duplicate_of_id as original_id from listings where duplicate_of_id is not null and duplicate_of_id not in (select id from listings where id % 3 <> 0 or duplicate_of_id is not null)")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    links = df.where("duplicate_of_id is not null").select("id", "duplicate_of_id")
    return duplicates.dangling(df.where("id % 3 <> 0").select("id", F.lit(None).cast("long").alias("duplicate_of_id")).unionByName(links)).select("id", "original_id")


@query("favorites_join", f"{W}select user_id, id, price from (select distinct user_id, event_id * 3 as id from events where event_type = 'click') f join listings using (id)")
def _(spark, sf_dir):
    marks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") * 3).alias("id")).distinct()
    return marks.join(listings(spark, sf_dir), "id").select("user_id", "id", "price")


@query("completeness", f"{W}select source_key, count(*) as n, " + ", ".join(f"round(100.0 * count({c}) / count(*), 2) as {c}_pct" for c in ("area", "floor", "street", "initial_price", "phone")) + " from listings group by source_key")
def _(spark, sf_dir):
    return stats.completeness(listings(spark, sf_dir), ["area", "floor", "street", "initial_price", "phone"])


@query("price_bands", f"{W}select case when price_per_m2 is null then -1 when price_per_m2 < 6000 then 0 when price_per_m2 < 9000 then 1 when price_per_m2 < 12000 then 2 when price_per_m2 < 16000 then 3 else 4 end as band, count(*) as n, round(max(price_per_m2), 2) as top from listings where {_ACTIVE} group by 1")
def _(spark, sf_dir):
    return listings(spark, sf_dir).where(_ACTIVE).groupBy(geo.price_band(F.col("price_per_m2")).alias("band")).agg(F.count("*").alias("n"), F.round(F.max("price_per_m2"), 2).alias("top"))


@query("contacts_provenance", f"""{W}, l as (select *, coalesce(duplicate_of_id, id) as root from listings where {_ACTIVE}), known as (select id, phone as number, 1 as rank, 'listing' as origin from l where phone is not null
union all select id, '22' || lpad(cast(s_suppkey as string), 7, '0'), 2, 'agency' from l join supplier on s_suppkey = agency_id and s_suppkey % 3 = 0),
bare as (select id, root from l where id not in (select id from known)), grp as (select id, root, phone, row_number() over (partition by root order by id) as n from l where root in (select root from bare)),
both_ as (select * from known union all select b.id, g.phone, 3, 'twin' from bare b join grp g on g.root = b.root and g.n <= 8 and g.id <> b.id where g.phone is not null)
select id, number, min(rank) as rank, arg_min(origin, rank) as origin from both_ group by id, number""")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).where(_ACTIVE)
    own = df.where("phone is not null").select(F.col("id").alias("listing_id"), F.col("phone").alias("number"))
    agency = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("agency_id"), F.concat(F.lit("22"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("number"))
    return agencies.contacts(df, own, agency)


@query("saved_search_matches", f"""{W}select 1 as search_id, id from (select id from listings where {_BASE} and property_type = 'mieszkanie' and price <= 100000 order by listed_at desc nulls last, id desc limit 50)
union all select 2, id from (select id from listings where {_BASE} and kind = 'licytacja' order by listed_at desc nulls last, id desc limit 50)""")
def _(spark, sf_dir):
    from kadastra.operators import alerts

    searches = {1: Filters(property_type="mieszkanie", price_max=100000.0), 2: Filters(kind="licytacja")}
    return alerts.matches(listings(spark, sf_dir), searches, NOW)


@query("text_fold", f"select doc_id, {fold_sql('text')} as folded from documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))
