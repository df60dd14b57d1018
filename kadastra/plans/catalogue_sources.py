"""Registered queries: readers of landed payloads, and the repairs that need a registry. Payloads are made of the listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.operators import repair
from kadastra.plans import sample_places
from kadastra.plans.views import LISTINGS_SQL, NOW, listings
from kadastra.sources import payloads, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W = f"with {LISTINGS_SQL}\n"
UNITS = ", ".join(f"('{u[0]}', '{u[1]}', '{u[4]}', '{u[3]}')" for u in sample_places.UNITS if u[2] in ("miasto", "gmina"))
TOWNS = f"(values {UNITS}) u(teryt, name, unit_county, region)"


def query(name: str, sql_text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql_text is not None:
            ORACLE_SQL[name] = sql_text
        return f

    return add


def made(df: DataFrame, **fields: str) -> Column:
    """A JSON object of SQL expressions over the listings."""
    return F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in fields.items())))


def page(data: Column) -> Column:
    return F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))


ROOM_WORDS = "coalesce(try_element_at(array('ONE', 'TWO', 'THREE', 'FOUR', 'FIVE', 'SIX', 'SEVEN', 'EIGHT', 'NINE', 'TEN'), cast(rooms as int)), cast(rooms as string))"


@query("portal_offers", f"{W}select cast(id as string) as external_id, case when id % 9 <> 0 then price end as price, area, rooms, cast(floor as int) as floor, city, county, voivodeship, case when id % 4 = 0 then 'prywatna' else 'posrednik' end as seller_type from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    item = made(
        df, id="cast(id as string)", slug="concat('oferta-', id)", title="concat('Oferta ', id)", totalPrice="named_struct('value', price)", hidePrice="id % 9 = 0", areaInSquareMeters="area", roomsNumber=ROOM_WORDS, floorNumber="concat('FLOOR_', floor)", isPrivateOwner="id % 4 = 0",
        location="named_struct('reverseGeocoding', named_struct('locations', array(named_struct('locationLevel', 'voivodeship', 'name', voivodeship), named_struct('locationLevel', 'county', 'name', county))), 'address', named_struct('city', named_struct('name', city)))",
        agency="case when id % 4 <> 0 then named_struct('name', 'Biuro') end",
    )
    landed = df.select(page(F.concat(F.lit('{"props": {"pageProps": {"data": {"searchAds": {"items": ['), item, F.lit("]}}}}}"))).alias("html"))
    return payloads.portal_offers(landed).select("external_id", "price", "area", "rooms", "floor", "city", "county", "voivodeship", "seller_type")


@query("portal_lists", f"{W}select id, price from (select id, price, count(*) over (partition by id // 10) as n from listings) where n >= 3")
def _(spark, sf_dir):
    """Pages of three to ten offers in depths of their own, before them a breadcrumb with slugs and titles, behind them one promoted offer."""
    df = listings(spark, sf_dir)
    rows = df.select(F.floor(F.col("id") / 10).alias("g"), made(df, slug="cast(id as string)", title="'Oferta'", totalPrice="named_struct('value', price)").alias("item")).groupBy("g").agg(F.collect_list("item").alias("items")).where("size(items) >= 3")
    deep = [F.when(F.col("g") % 2 == 0, F.repeat(F.lit(x), F.lit(20))).otherwise("") for x in ('{"x": [', "]}")]
    crumb, promoted = '[{"slug": "p", "title": "Polska"}, {"slug": "o", "title": "Opole"}, {"slug": "r", "title": "Rynek"}]', '[{"slug": "top", "title": "Promowana", "price": 1}]'
    found = F.concat(F.lit('{"props": {"breadcrumb": ' + crumb + ', "found": '), deep[0], F.lit("["), F.array_join("items", ","), F.lit("]"), deep[1], F.lit(', "organic": ' + promoted + "}}"))
    return payloads.portal_offers(rows.select(page(found).alias("html"))).select(F.col("external_id").cast("long").alias("id"), "price")


_DETAIL = "case when id % 3 = 0 then '600100200; 77 111 22 33' else '600100200' end"


@query("portal_details", f"{W}select 'u' || cast(id as string) as url, {_DETAIL} as phones_raw, 'Opis ' || cast(id as string) as description, 1900 + id % 120 as year_built, case when id % 5 = 0 then 0 when id % 5 = 1 then -1 when id % 5 = 2 then 99 else id % 40 end as floor, case when id % 2 = 0 then 'pierwotny' else 'wtorny' end as market, county, city from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    ad = made(
        df, description="concat('  Opis ', id)", contactDetails="named_struct('phones', array('600100200', '', '600100200'))", owner="case when id % 3 = 0 then named_struct('phones', array('77 111 22 33', '600100200')) end",
        target="named_struct('Build_year', concat(1900 + id % 120, case when id % 4 = 0 then '.0' else '' end), 'Floor_no', array(case id % 5 when 0 then 'ground_floor' when 1 then 'cellar' when 2 then 'attic' else concat('floor_', id % 40) end))",
        characteristics="array(named_struct('key', 'rent', 'value', '1'), named_struct('key', 'market', 'value', case when id % 2 = 0 then 'PRIMARY' else 'secondary' end))",
        location="named_struct('reverseGeocoding', named_struct('locations', array(named_struct('locationLevel', 'county', 'name', county), named_struct('locationLevel', 'city_or_village', 'name', city), named_struct('locationLevel', 'city_or_village', 'name', 'later'))))",
    )
    landed = df.select(F.concat(F.lit("u"), F.col("id")).alias("url"), page(F.concat(F.lit('{"props": {"pageProps": {"ad": '), ad, F.lit("}}}"))).alias("html"))
    return payloads.portal_details(landed).select("url", F.array_join("phones_raw", "; ").alias("phones_raw"), "description", F.col("year_built").cast("long").alias("year_built"), F.col("floor").cast("long").alias("floor"), "market", "county", "city")


@query("state_offers", f"{W}select cast(id as string) as external_id, price, area, cast(rooms as int) as rooms, city, 'Sieradzka' as street, case when transaction = 'wynajem' then 'wynajem' else 'sprzedaz' end as transaction from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    item = made(df, id="cast(id as string)", slug="concat('oferta-', id)", name="concat('Oferta ', id)", deal_type="case when transaction = 'wynajem' then 'rent' else 'sell' end", price="named_struct('total', cast(price as string))", property="named_struct('size', cast(area as string), 'room_number', rooms, 'address_details', named_struct('city', city, 'street', 'ul. Sieradzka'))")
    html = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"offerList": {"offers": {"offers": ['), item, F.lit("]}}};</script>"))
    return payloads.state_offers(df.select(html.alias("html"))).select("external_id", "price", "area", "rooms", "city", "street", "transaction")


@query("readers_by_registry", f"{W}select ['a', 'b', 'c'][id % 5 + 1] as source_key, ['state', 'rest', 'official_auctions'][id % 5 + 1] as scraper, cast(id as string) as external_id, price, case when id % 5 < 2 then city end as city from listings where id % 5 < 3")
def _(spark, sf_dir):
    """Three sources with readers of their own, one that is disabled, and one that the registry does not know."""
    df = listings(spark, sf_dir).withColumn("source_key", F.expr("element_at(array('a', 'b', 'c', 'off', 'unknown'), cast(id % 5 as int) + 1)"))
    state = made(df, id="cast(id as string)", slug="cast(id as string)", name="concat('Oferta ', id)", price="named_struct('total', cast(price as string))", property="named_struct('address_details', named_struct('city', city))")
    rest = made(df, id="cast(id as string)", title="title", params="array(named_struct('key', 'price', 'value', named_struct('value', cast(price as string))))", location="named_struct('city', named_struct('name', city))")
    auction = made(df, uuid="cast(id as string)", title="concat('Oferta ', id)", startingPrice="cast(price as string)")
    state_page = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"offerList": {"offers": {"offers": ['), state, F.lit("]}}};</script>"))
    body = F.when(F.col("source_key") == "b", rest).when(F.col("source_key") == "c", F.concat(F.lit('{"content": ['), auction, F.lit("]}"))).otherwise(state_page)
    documents = df.select("source_key", F.concat(F.lit("https://x.pl/"), "id").alias("url"), body.alias("body"), F.lit(None).cast("string").alias("phrase"))
    sources = spark.createDataFrame([("a", "state", True), ("b", "rest", True), ("c", "official_auctions", True), ("off", "state", False)], readers.SOURCE)
    return readers.read(documents, sources, F.lit(NOW).cast("timestamp")).select("source_key", "scraper", "external_id", "price", "city")


@query("official_auctions", f"{W}select 'u' || cast(id as string) as external_id, price as opening_price, city as location_text from listings where id % 11 <> 0")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    item = made(df, uuid="concat('u', id)", title="concat('Oferta ', id)", startingPrice="cast(price as string)", localization="city", cancellationDateTime="case when id % 11 = 0 then '2001-01-01' end")
    return payloads.official_auctions(df.select(F.concat(F.lit('{"content": ['), item, F.lit(","), item, F.lit("]}")).alias("value"))).select("external_id", "opening_price", "location_text")


@query("bailiff_auctions", f"{W}select cast(id as string) as external_id, cast(1000 + id % 900 as double) * 1000 as estimate_value, cast(1000 + id % 900 as double) * 100 as deposit, 'Km ' || cast(id % 999 + 1 as string) || '/24' as case_number from listings where id % 3 = 0")
def _(spark, sf_dir):
    amount = F.regexp_replace(F.format_number((1000 + F.col("id") % 900) * 1000, 0), ",", " ")
    mode = F.when(F.col("id") % 3 == 0, "Licytacja elektroniczna").otherwise("Licytacja stacjonarna")
    html = F.concat(F.lit('<a class="auction" href="/licytacje/'), F.col("id"), F.lit('/x"><div class="auction__tags">'), mode, F.lit('</div><h3 class="auction__title">Lokal Km '), F.col("id") % 999 + 1, F.lit('/24</h3><div class="auction__price">Suma oszacowania '), amount, F.lit(" zł</div></a>"))
    return payloads.bailiff_auctions(listings(spark, sf_dir).select(html.alias("html")), electronic=True).select("external_id", "estimate_value", "deposit", "case_number")


@query("notices_by_phrase", f"{W}select cast(id as string) as external_id, case when id % 2 = 0 then 'działka' else 'lokal' end as phrase, 'Obwieszczenie MSiG 7: Oferta ' || cast(id as string) as title from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    value = F.concat(F.lit('{"list": ['), made(df, id="cast(id as string)", entityName="concat('Oferta ', id)", monitorNumber="'7'"), F.lit("]}"))
    rows = df.select("id", value.alias("value"))
    found = rows.select(F.lit("lokal").alias("phrase"), "value").unionByName(rows.where("id % 2 = 0").select(F.lit("działka").alias("phrase"), "value"))
    return payloads.notices_by_phrase(found).select("external_id", "phrase", "title")


@query("notices_by_word", f"{W}select cast(id as string) as external_id, price as opening_price, floor(price / 10) as deposit from listings where id % 3 = 0")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    value = made(df, id="cast(id as string)", tytul="case when id % 3 = 0 then 'Sprzedaż nieruchomości' else 'Ogłoszenie upadłości' end", tresc="'bez szczegółów'", cenaWywolawcza="cast(price as string)", wadium="cast(floor(price / 10) as string)")
    return payloads.notices_by_word(df.select(value.alias("value"))).select("external_id", "opening_price", "deposit")


@query("tenders", f"{W}select 'n' || cast(id as string) as external_id, price, case when id % 5 <> 0 then '4500' || cast(id % 2 as string) end as cpv from listings where voivodeship = 'EUROPE' and id % 7 <> 0 and (id % 5 = 0 or id % 2 = 0)")
def _(spark, sf_dir):
    df = listings(spark, sf_dir)
    item = made(df, noticeNumber="concat('n', id)", orderObject="concat('Oferta ', id)", orderValue="cast(price as string)", organizationProvince="voivodeship", noticeType="case when id % 7 = 0 then 'Z' else 'A' end", cpvCode="case when id % 5 <> 0 then concat('4500', id % 2) end")
    return payloads.tenders(df.select(F.concat(F.lit('{"items": ['), item, F.lit("]}")).alias("value")), "EUROPE", ("45000",), ("Z",)).select("external_id", "price", "cpv")


@query("agency_directory", "select cast(s_suppkey as string) as external_id, s_name as name, 'małopolskie' as voivodeship, cast(s_suppkey % 50 + 1 as int) as expected from supplier where s_suppkey % 6 <> 0")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    item = made(df, id="cast(s_suppkey as string)", name="s_name", status="case when s_suppkey % 6 = 0 then 'DELETED' else 'ACTIVE' end", location="named_struct('fullName', 'Kraków, małopolskie')", statistics="named_struct('adsSell', named_struct('activeAdsCount', s_suppkey % 50), 'adsRent', named_struct('activeAdsCount', 1))")
    landed = df.select(page(F.concat(F.lit('{"a": {"accounts": ['), item, F.lit("]}}"))).alias("html"))
    return payloads.agency_directory(landed).select("external_id", "name", "voivodeship", "expected")


@query("card_address", f"{W}select id, case when id % 3 <> 2 then 'opolskie' end as voivodeship, case when id % 3 = 1 then 'nyski' end as county, case id % 3 when 0 then 'Opole' when 1 then 'Nysa' else 'Florynka' end as city, case when id % 3 = 0 then 'Centrum' end as district, case when id % 3 = 0 then 'Rynek ' || cast(id % 9 as string) end as street from listings")
def _(spark, sf_dir):
    address = F.expr("case id % 3 when 0 then concat('Rynek ', id % 9, ', Centrum, Opole, opolskie') when 1 then 'Nysa, nyski, opolskie' else ' Florynka ' end")
    return payloads.card_address(listings(spark, sf_dir).select("id", address.alias("address")), sample_places.units(spark), ["opolskie", "pomorskie"])


def _placed(df: DataFrame, **more: str) -> DataFrame:
    return df.select("id", "source_key", *(F.expr(v).alias(k) for k, v in more.items()))


@query("repair_regions", f"{W}select id, case id % 4 when 0 then 'opolskie' when 1 then 'pomorskie' when 3 then 'zachodnie' end as voivodeship, case id % 4 when 0 then 'Opole' when 1 then 'starogardzki' end as county from listings")
def _(spark, sf_dir):
    df = _placed(listings(spark, sf_dir), city="case id % 4 when 0 then 'Opole' when 1 then 'Osiek' when 2 then 'Osiek' else 'Opole' end", county="case when id % 4 = 1 then 'starogardzki' end", voivodeship="case when id % 4 = 3 then 'zachodnie' end")
    return repair.regions_of_places(df, sample_places.units(spark)).select("id", "voivodeship", "county")


@query("repair_by_title", f"{W}select id, case when id % 3 = 0 and source_key <> 'src1' then 'Sopot' else 'Nysa' end as city, case when id % 3 = 0 and source_key <> 'src1' then 'pomorskie' else 'opolskie' end as voivodeship, case when id % 3 = 0 and source_key <> 'src1' then null else 50.0 end as lat from listings")
def _(spark, sf_dir):
    df = _placed(listings(spark, sf_dir), title="case id % 3 when 0 then 'Dom w Sopocie' when 1 then 'Dobra oferta' else 'Lokal w Nysie' end", city="'Nysa'", county="'nyski'", commune="'Nysa'", voivodeship="'opolskie'", lat="50.0D", lon="17.0D")
    return repair.relocate_by_title(df, sample_places.units(spark), ["src1"]).select("id", "city", "voivodeship", "lat")


@query("repair_default_region", f"{W}select id, case id % 4 when 0 then 'opolskie' when 1 then 'pomorskie' when 2 then 'pomorskie' end as voivodeship from listings")
def _(spark, sf_dir):
    df = _placed(listings(spark, sf_dir), city="case id % 4 when 0 then 'Opole' when 1 then 'Sopot' when 2 then 'X' else 'Osiek' end", teryt="case when id % 4 = 0 then '166101' end", county="'c'", commune="'c'", voivodeship="'opolskie'", lat="case when id % 4 = 2 then 54.0D end", lon="case when id % 4 = 2 then 18.0D end")
    boxes = spark.createDataFrame([("opolskie", 50.0, 51.0, 17.0, 18.5), ("pomorskie", 53.5, 54.9, 16.7, 19.6)], "voivodeship string, lat_min double, lat_max double, lon_min double, lon_max double")
    return repair.default_region(df, sample_places.units(spark), boxes).select("id", "voivodeship")


@query("repair_dates_from_raw", f"{W}select id, case when source_key = 'src1' then listed_at + interval 3 hour else listed_at end as published_at from listings")
def _(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", "source_key", F.col("listed_at").cast("timestamp_ntz").alias("published_at"), F.concat(F.lit('{"jsonld": {"datePosted": "'), F.date_format(F.col("listed_at") + F.expr("interval 3 hour"), "yyyy-MM-dd HH:mm:ss"), F.lit('"}}')).alias("raw"))
    again = repair.dates_from_raw(df, F.lit(NOW).cast("timestamp"), {"src1": {"published_at": ["datePosted", "jsonld.datePosted"]}})
    return again.select("id", F.col("published_at").cast("timestamp").alias("published_at"))


CARDS = [
    ("src0", "div.card", None, "h2", ".price", ".area", ".place", None, None, "nieruchomosc", None, None),
    ("src1", "ul.found > li", "a.go", "a.go", "b", None, "i", None, None, "nieruchomosc", "posrednik", None),
    ("src2", "a.tile", None, "strong", "em[data-kind=price]", None, None, None, None, "licytacja", None, None),
    ("src3", "section article", None, "h3", None, None, None, None, None, "nieruchomosc", None, None),
]


@query("selector_offers", f"{W}select source_key, 'https://' || source_key || '.pl/o/' || cast(id as string) as url, 'Oferta ' || cast(id as string) as title, cast(1000 + id % 9000 as double) as price, case when source_key = 'src0' then area end as area, case when source_key in ('src0', 'src1') then city end as location_text, case source_key when 'src1' then 'posrednik' else 'nieznany' end as seller_type from listings where source_key in ('src0', 'src1', 'src2')")
def _(spark, sf_dir):
    """List pages of ten offers, of three sources with markup and selectors of their own; a fourth has other pages than it says."""
    from kadastra.sources import cards

    df = listings(spark, sf_dir).where("source_key in ('src0', 'src1', 'src2', 'src3')")
    i, price = F.col("id").cast("string"), (F.lit(1000) + F.col("id") % 9000).cast("string")
    kind = F.col("source_key")
    card = (
        F.when(kind == "src0", F.concat(F.lit('<div class="card wide"><h2> Oferta '), i, F.lit('</h2><a href="/o/'), i, F.lit('">więcej</a><span class="price">'), price, F.lit(' zł</span><span class="x area">'), F.coalesce(F.col("area").cast("string"), F.lit("")), F.lit(' m²</span><p class="place">'), F.col("city"), F.lit("</p></div>")))
        .when(kind == "src1", F.concat(F.lit('<li><a href="/menu">menu</a><a class="go" href="https://src1.pl/o/'), i, F.lit('">Oferta '), i, F.lit("</a><b>"), price, F.lit(" PLN</b><i>"), F.col("city"), F.lit("</i>")))
        .when(kind == "src2", F.concat(F.lit('<a class="tile" href="//src2.pl/o/'), i, F.lit('"><strong>Oferta '), i, F.lit("</strong><em>0 zł</em><em data-kind=price>"), price, F.lit(" zł</em></a>")))
        .otherwise(F.concat(F.lit('<div class="card"><h3>Oferta '), i, F.lit("</h3></div>")))
    )
    pages = df.withColumn("card", card).groupBy("source_key", F.floor(F.col("id") / 60).alias("page")).agg(F.array_join(F.array_sort(F.collect_list("card")), "\n").alias("cards"))
    body = F.concat(F.lit('<html><body><nav><a href="/">x</a></nav><ul class="found">'), F.col("cards"), F.lit("</ul></body></html>"))
    landed = pages.select("source_key", F.concat(F.lit("https://"), F.col("source_key"), F.lit(".pl/szukaj?page="), F.col("page")).alias("url"), body.alias("html"))
    found = cards.offers(landed, spark.createDataFrame(CARDS, cards.SOURCE), F.lit(NOW).cast("timestamp"))
    return found.select("source_key", "url", "title", "price", F.when(F.col("source_key") == "src0", F.col("area")).alias("area"), "location_text", "seller_type")


_ROAD = "regexp_replace(street, ' [0-9].*$', '')"
_REGISTER = f"select id, city, voivodeship, district, case when id % 3 <> 0 then {_ROAD} end as street, case when id % 3 = 1 then cast(id % 50 + 1 as string) end as number, round(48.5 + (id % 83) / 20.0, 4) as lat, round(15.0 + (id % 71) / 20.0, 4) as lon from listings where id % 4 = 0"

@query("geocode_levels", f"""{W}, r as ({_REGISTER}), t as (select id, city, voivodeship, case when id % 5 < 2 then district end as district, case when id % 5 > 2 then {_ROAD} end as street, case when id % 5 = 3 then cast(id % 50 + 1 as string) end as number from listings where id % 4 <> 0),
a as (select city, voivodeship, street, number, avg(lat) as lat, avg(lon) as lon from r where street is not null and number is not null group by all), s as (select city, voivodeship, street, avg(lat) as lat, avg(lon) as lon from r where street is not null group by all),
d as (select city, voivodeship, district, avg(lat) as lat, avg(lon) as lon from r where district is not null group by all), c as (select city, voivodeship, avg(lat) as lat, avg(lon) as lon from r group by all),
j as (select t.id, a.lat as a_lat, s.lat as s_lat, c.lat as c_lat, case when t.street is null and 12742 * asin(sqrt(pow(sin(radians(c.lat - d.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(d.lat)) * pow(sin(radians(c.lon - d.lon) / 2), 2))) <= 15 then d.lat end as d_lat
from t left join c on c.city = t.city and c.voivodeship = t.voivodeship left join d on d.city = t.city and d.voivodeship = t.voivodeship and d.district = t.district left join s on s.city = t.city and s.voivodeship = t.voivodeship and s.street = t.street left join a on a.city = t.city and a.voivodeship = t.voivodeship and a.street = t.street and a.number = t.number)
select id, case when a_lat is not null then 'address' when s_lat is not null then 'street' when d_lat is not null then 'district' when c_lat is not null then 'city' end as geo_precision, round(coalesce(a_lat, s_lat, d_lat, c_lat) + 0.00001234, 4) as lat from j""")
def _(spark, sf_dir):
    """A quarter of the listings are a register of addresses; the others have lost their points, and some of them more."""
    from kadastra.operators import geocoder

    df = listings(spark, sf_dir).withColumn("street", F.expr(_ROAD))
    i = F.col("id")
    register = df.where("id % 4 = 0").select("id", "city", "voivodeship", "district", F.when(i % 3 != 0, F.col("street")).alias("street"), F.when(i % 3 == 1, (i % 50 + 1).cast("string")).alias("number"), F.round(48.5 + (i % 83) / 20.0, 4).alias("lat"), F.round(15.0 + (i % 71) / 20.0, 4).alias("lon"))
    street = F.when(i % 5 == 3, F.concat_ws(" ", "street", (i % 50 + 1).cast("string"))).when(i % 5 > 3, F.col("street"))
    asked = df.where("id % 4 <> 0").select("id", "city", "voivodeship", F.when(i % 5 < 2, F.col("district")).alias("district"), F.when(F.col("street").isNotNull(), street).alias("street"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return geocoder.cascade(asked, register).select("id", "geo_precision", F.round(F.col("lat") + 0.00001234, 4).alias("lat"))
