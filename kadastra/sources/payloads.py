"""Readers of landed payloads: portal pages with embedded JSON, official auctions, notices and tenders, agency directories.

Each takes a table of landed texts and returns offers (or agencies) as rows; fetching is not part of it. Documents whose
shape varies are searched by a small helper that finds the list of items; everything else is ``from_json`` and columns.
``keep`` names columns of the landed table that go along with each offer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra.functions import dates, numbers, text
from kadastra.operators import places
from kadastra.sources import pages

# The words by which sources mark what is wanted.
LEVELS = {"voivodeship": "voivodeship", "county": "county", "commune": "commune", "city_or_village": "city", "district": "district"}
SALE_WORDS = r"(?i)sprzeda|przetarg|licytacj|nieruchomo|lokal|działk|grunt|budyn"
ELECTRONIC = r"(?i)elektron"
#: Names under which portals keep what a page lists, looked into first; and what an offer has beside its title.
KNOWN_NAMES = ("items", "searchAds", "ads", "organic", "data", "pageProps", "props")
OFFER_FIELDS = ("totalPrice", "areaInSquareMeters", "price")
#: So many items make a list; links, breadcrumbs and promoted singles are shorter.
LEAST_ITEMS = 3


def items_in(document: Column, needed: tuple[str, ...], one_of: tuple[str, ...] = (), first: tuple[str, ...] = KNOWN_NAMES) -> Column:
    """The items of a JSON document, as texts: the first list that has LEAST_ITEMS objects with all the ``needed`` fields and one of
    ``one_of``, wherever and however deep it is; without such a list the first that has most of them.

    Objects are searched in their order, but for the names in ``first``, which come before the others. What is no JSON
    document, or too deep for a parser, has no items."""

    def search(document) -> list[dict]:
        best, stack = [], [document]
        while stack:
            value = stack.pop()
            if isinstance(value, list):
                hits = [v for v in value if isinstance(v, dict) and all(n in v for n in needed) and (not one_of or any(n in v for n in one_of))]
                if len(hits) >= LEAST_ITEMS:
                    return hits
                if len(hits) > len(best):
                    best = hits
                inner = value
            else:
                names = [n for n in first if n in value]
                inner = [value[n] for n in (*names, *(n for n in value if n not in first))]
            stack += [x for x in reversed(inner) if isinstance(x, (dict, list))]
        return best

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        def items(t):
            try:
                found = json.loads(t)
            except (TypeError, ValueError, RecursionError):
                return []
            return [json.dumps(x, ensure_ascii=False) for x in search(found)] if isinstance(found, (dict, list)) else []

        return texts.map(items)

    return of(document)


def clean(value: Column) -> Column:
    return F.nullif(text.clean(value), F.lit(""))


def hierarchy(levels: Column, field: str) -> Column:
    """The name at one level of a list of (locationLevel, name); the first if it is there twice."""
    level = next(k for k, v in LEVELS.items() if v == field)
    return clean(F.get(F.filter(levels, lambda x: (x["locationLevel"] == level) & (F.length(F.trim(x["name"])) > 0)), 0)["name"])


_NAMED = "struct<name:string>"
PORTAL = (
    "id string, slug string, title string, shortDescription string, totalPrice struct<value:double>, hidePrice boolean, rentPrice struct<value:double>, areaInSquareMeters double, terrainAreaInSquareMeters double, roomsNumber string, floorNumber string,"
    f" location struct<address:struct<city:{_NAMED},street:{_NAMED},district:{_NAMED},county:{_NAMED},province:{_NAMED}>,reverseGeocoding:struct<locations:array<struct<locationLevel:string,name:string>>>,coordinates:struct<latitude:double,longitude:double>>,"
    " agency struct<name:string,type:string>, isPrivateOwner boolean, market string, images array<struct<large:string,medium:string,small:string>>, dateCreatedFirst string, dateCreated string"
)
# Numbers in words.
ROOMS = {"ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5, "SIX": 6, "SEVEN": 7, "EIGHT": 8, "NINE": 9, "TEN": 10, "MORE": 11}
FLOORS = {"CELLAR": -1, "GROUND": 0, "FIRST": 1, "SECOND": 2, "THIRD": 3, "FOURTH": 4, "FIFTH": 5, "SIXTH": 6, "SEVENTH": 7, "EIGHTH": 8, "NINTH": 9, "TENTH": 10, "HIGHER_10": 11, "GARRET": None}


def _word(value: Column, words: dict) -> Column:
    """A number in digits or in words."""
    told = F.regexp_replace(F.upper(value), "^FLOOR_", "")
    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.lit(v).cast("int")))), told), told.try_cast("int"))


def portal_offers(landed: DataFrame, html: str = "html", base: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Offers in the embedded JSON of a portal's list pages: the items are wherever the page keeps them; places by level of the
    administrative hierarchy before those of the address; a hidden price is no price; times are Warsaw's."""
    items = landed.select(*keep, F.explode(items_in(pages.next_data(F.col(html)), ("slug", "title"), OFFER_FIELDS)).alias("item"))
    o = items.select(*keep, F.from_json("item", PORTAL).alias("o")).where("length(trim(o.slug)) > 0 and length(trim(o.title)) > 0")
    at = lambda field, address: F.coalesce(hierarchy(F.col("o.location.reverseGeocoding.locations"), field), *([clean(F.col(f"o.location.address.{address}.name"))] if address else []))
    seller = F.when(F.col("o.isPrivateOwner"), "prywatna").when(F.upper("o.agency.type") == "DEVELOPER", "deweloper").when(F.col("o.agency").isNotNull(), "posrednik").otherwise("nieznany")
    images = F.filter(F.transform("o.images", lambda i: F.coalesce(i["large"], i["medium"], i["small"])), lambda x: x.isNotNull())
    return o.select(
        *keep,
        F.coalesce("o.id", "o.slug").alias("external_id"),
        F.concat(F.lit(base), F.col("o.slug")).alias("url"),
        clean(F.col("o.title")).alias("title"),
        clean(F.col("o.shortDescription")).alias("description"),
        F.when(~F.coalesce("o.hidePrice", F.lit(False)), F.col("o.totalPrice.value")).alias("price"),
        F.col("o.rentPrice.value").alias("rent"),
        F.col("o.areaInSquareMeters").alias("area"),
        F.col("o.terrainAreaInSquareMeters").alias("plot_area"),
        _word(F.col("o.roomsNumber"), ROOMS).alias("rooms"),
        _word(F.col("o.floorNumber"), FLOORS).alias("floor"),
        at("voivodeship", "province").alias("voivodeship"),
        at("county", "county").alias("county"),
        at("commune", None).alias("commune"),
        at("city", "city").alias("city"),
        at("district", "district").alias("district"),
        clean(F.col("o.location.address.street.name")).alias("street"),
        F.col("o.location.coordinates.latitude").alias("lat"),
        F.col("o.location.coordinates.longitude").alias("lon"),
        seller.alias("seller_type"),
        clean(F.col("o.agency.name")).alias("seller_name"),
        F.slice(images, 1, 12).alias("images"),
        F.when(F.col("o.market") == "PRIMARY", "pierwotny").when(F.col("o.market") == "SECONDARY", "wtorny").alias("market"),
        dates.parse_moment(F.coalesce("o.dateCreatedFirst", "o.dateCreated"), F.lit(None).cast("timestamp"), naive_local=True).alias("published_at"),
    )


# Floors in words on detail pages.
DETAIL_FLOORS = {"ground_floor": 0, "cellar": -1, "garret": 99, "attic": 99}
_TEXTS = "array<string>"
DETAIL = (
    f"description string, contactDetails struct<phones:{_TEXTS}>, owner struct<phones:{_TEXTS}>, characteristics array<struct<key:string,value:string>>,"
    f" target struct<Build_year:string,Building_floors_num:string,Terrain_area:string,Floor_no:{_TEXTS},Building_type:{_TEXTS}>,"
    f" location struct<address:struct<street:{_NAMED}>,reverseGeocoding:struct<locations:array<struct<locationLevel:string,name:string>>>,coordinates:struct<latitude:double,longitude:double>>"
)


def portal_details(landed: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """What a portal's detail pages tell beside the list: phones (the agent's, then the office's, each once), the full description,
    year, floor, floors, building, plot, point, market and place. One row for each page with an offer in its embedded JSON;
    ``upsert.fill_empty`` brings it to the listings."""
    rows = landed.select(F.col(url).alias("url"), F.from_json(F.get_json_object(pages.next_data(F.col(html)), "$.props.pageProps.ad"), DETAIL).alias("ad")).where("ad is not null")
    phones = F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(f"ad.{c}.phones", F.array().cast("array<string>")) for c in ("contactDetails", "owner"))), clean), lambda x: x.isNotNull()))
    whole = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(-?\d+)(?:\.0*)?\s*$", 1).try_cast("int")
    told = F.get("ad.target.Floor_no", F.lit(0))
    floor = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in DETAIL_FLOORS.items() for x in (F.lit(k), F.lit(v)))), told), F.regexp_extract(told, r"^floor_(\d+)$", 1).try_cast("int"))
    market = F.get(F.filter("ad.characteristics", lambda c: c["key"] == "market"), F.lit(0))["value"]
    at = lambda level: hierarchy(F.col("ad.location.reverseGeocoding.locations"), level)
    return rows.select(
        "url", phones.alias("phones_raw"), clean(F.col("ad.description")).alias("description"), whole(F.col("ad.target.Build_year")).alias("year_built"), floor.alias("floor"), whole(F.col("ad.target.Building_floors_num")).alias("floors_total"),
        clean(F.get("ad.target.Building_type", F.lit(0))).alias("building_type"), numbers.parse_number(F.col("ad.target.Terrain_area")).alias("plot_area"), F.col("ad.location.coordinates.latitude").alias("lat"), F.col("ad.location.coordinates.longitude").alias("lon"),
        F.when(F.lower(market) == "primary", "pierwotny").when(F.lower(market) == "secondary", "wtorny").alias("market"), *(at(level).alias(level) for level in LEVELS.values()), clean(F.col("ad.location.address.street.name")).alias("street"),
    )


STATE = "struct<offerList:struct<offers:struct<offers:array<struct<id:string,slug:string,name:string,description:string,deal_type:string,price:struct<total:string>,property:struct<type:string,size:string,room_number:string,building_year:string,floors:struct<floor:string,building_floors:string>,address_details:struct<city:string,street:string>>,coordinates:struct<lat:double,lon:double>,agency:struct<name:string,type:string>,agent:struct<name:string,last_name:string,phone_number:string>,is_private:boolean,market_type:string,created_at:string>>>>>"


def mislabelled(moment: Column) -> Column:
    """A Warsaw wall clock that a portal labels as UTC, in UTC."""
    return dates.parse_moment(F.regexp_replace(F.trim(moment), "Z$", ""), F.lit(None).cast("timestamp"), naive_local=True)


def state_offers(landed: DataFrame, html: str = "html", base: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Offers in the initial state of a portal's list pages; numbers come as texts or numbers, times with a wrong zone."""
    rows = landed.select(*keep, F.explode(F.from_json(pages.initial_state(F.col(html)), STATE)["offerList"]["offers"]["offers"]).alias("o"))
    rows = rows.where("length(trim(o.slug)) > 0 and length(trim(o.name)) > 0")
    agent = clean(F.concat_ws(" ", "o.agent.name", "o.agent.last_name"))
    name = F.coalesce(clean(F.col("o.agency.name")), agent)
    seller = F.when(F.col("o.is_private"), "prywatna").when(F.col("o.agency.type") == "developer", "deweloper").when(name.isNotNull(), "posrednik").otherwise("nieznany")
    number = lambda c: numbers.parse_number(F.col(c))
    return rows.select(
        *keep,
        F.coalesce("o.id", "o.slug").alias("external_id"),
        F.concat(F.lit(f"{base}/oferta/"), F.col("o.slug"), F.lit("/")).alias("url"),
        clean(F.col("o.name")).alias("title"),
        clean(F.col("o.description")).alias("description"),
        F.when(F.col("o.deal_type") == "rent", "wynajem").otherwise("sprzedaz").alias("transaction"),
        F.col("o.property.type").alias("source_type"),
        number("o.price.total").alias("price"),
        number("o.property.size").alias("area"),
        number("o.property.room_number").cast("int").alias("rooms"),
        number("o.property.floors.floor").cast("int").alias("floor"),
        number("o.property.floors.building_floors").cast("int").alias("floors_total"),
        number("o.property.building_year").cast("int").alias("year_built"),
        F.when(F.col("o.market_type") == "primary_market", "pierwotny").otherwise("wtórny").alias("market"),
        clean(F.col("o.property.address_details.city")).alias("city"),
        clean(F.regexp_replace(F.trim("o.property.address_details.street"), r"(?i)^ul\.? ", "")).alias("street"),
        F.col("o.coordinates.lat").alias("lat"),
        F.col("o.coordinates.lon").alias("lon"),
        F.array_compact(F.array(clean(F.col("o.agent.phone_number")))).alias("phones_raw"),
        seller.alias("seller_type"),
        name.alias("seller_name"),
        mislabelled(F.col("o.created_at")).alias("published_at"),
    )


def official_auctions(landed: DataFrame, body: str = "value", base: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Auctions of a tax office's API ({content: [...]}): cancelled and void ones are dropped; of an item told more than once the last
    publication counts; begin and deposit are Warsaw wall clocks."""
    row = "struct<uuid:string,title:string,localization:string,startingPrice:string,saleBeginDateTime:string,saleEndDateTime:string,depositDueDate:string,publicationDateTime:string,cancellationDateTime:string,voidDateTime:string,electronicStateCode:string,announcementTypeCodes:array<string>>"
    rows = landed.select(*keep, F.explode(F.from_json(body, f"struct<content:array<{row}>>")["content"]).alias("r")).where("length(r.uuid) > 0 and length(trim(r.title)) > 0 and r.cancellationDateTime is null and r.voidDateTime is null").groupBy(*keep, "r.uuid").agg(F.max(F.struct(F.coalesce("r.publicationDateTime", F.lit("")).alias("since"), "r")).alias("last")).select(*keep, "last.r.*")
    price = numbers.parse_number(F.col("startingPrice"))
    wall = lambda c: F.try_to_timestamp(F.substring(F.translate(c, "T", " "), 1, 19)).cast("timestamp_ntz")
    return rows.select(*keep, F.col("uuid").alias("external_id"), F.concat(F.lit(f"{base}/auction/announcements/"), F.col("uuid")).alias("url"), F.lit("licytacja").alias("kind"), F.substring(text.clean(F.col("title")), 1, 400).alias("title"), price.alias("price"), price.alias("opening_price"), wall(F.col("saleBeginDateTime")).alias("event_date"), wall(F.coalesce("depositDueDate", "saleEndDateTime")).alias("deadline"), F.lit("urzad").alias("seller_type"), clean(F.col("localization")).alias("location_text"), numbers.area(F.col("title")).alias("area"))


def bailiff_auctions(landed: DataFrame, html: str = "html", electronic: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Auctions on a bailiffs' list page: one card a link; the deposit is a tenth of the estimate, as the law has it. With
    ``electronic``, only auctions held online."""
    cards = landed.select(*keep, F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'(?is)(<a\s[^>]*class="[^"]*\bauction\b[^"]*".*?</a>)'), 1)).alias("card"))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]{1,400}>", " "), r"\s+", " "))
    part = lambda pattern: clean(bare(F.regexp_extract("card", pattern, 1)))
    money = lambda word: numbers.parse_number(F.regexp_replace(part(rf'(?is)class="[^"]*auction__price[^"]*"[^>]*>((?:(?!</div>).)*{word}.*?)</div>'), r"^[^\d]*", ""))
    estimate, opening = money("oszacowan"), money("wywo[łl]a")
    rows = cards.select(
        *keep,
        F.nullif(F.regexp_extract("card", r"/licytacje/(\d+)", 1), F.lit("")).alias("external_id"),
        F.regexp_extract("card", r'href="([^"]+)"', 1).alias("url"),
        part(r'(?is)class="[^"]*auction__title[^"]*"[^>]*>(.*?)</').alias("title"),
        part(r'(?is)class="[^"]*auction__tags[^"]*"[^>]*>(.*?)</div>').alias("tags"),
        F.coalesce(opening, estimate).alias("price"), opening.alias("opening_price"), estimate.alias("estimate_value"), F.round(estimate / 10, 2).alias("deposit"),
        part(r'(?is)class="[^"]*auction__row--location[^"]*"[^>]*>(.*?)</div>').alias("location_text"),
    ).where("external_id is not null and title is not null")
    rows = rows.where(F.col("tags").rlike(ELECTRONIC)) if electronic else rows
    return rows.withColumns({"kind": F.lit("licytacja"), "seller_type": F.lit("komornik"), "case_number": numbers.case_number(F.col("title"))})


def notices_by_phrase(landed: DataFrame, phrase: str = "phrase", body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Notices of a court gazette ({list: [...]}) found by a phrase; one found by several counts once, by the first phrase."""
    rows = landed.select(*keep, F.col(phrase).alias("phrase"), F.explode(F.from_json(body, "struct<list:array<struct<id:string,entityName:string,monitorNumber:string,dateOfPublication:string,signatureOfCase:string>>>")["list"]).alias("r"))
    rows = rows.where("length(r.id) > 0 and length(trim(r.entityName)) > 0").groupBy(*keep, "r.id").agg(F.min(F.struct("phrase", "r")).alias("m")).select(*keep, "m.phrase", "m.r.*")
    entity, monitor = text.clean(F.col("entityName")), text.clean(F.col("monitorNumber"))
    return rows.select(*keep, F.col("id").alias("external_id"), F.lit("licytacja").alias("kind"), F.substring(F.concat(F.lit("Obwieszczenie MSiG "), monitor, F.lit(": "), entity), 1, 400).alias("title"), "phrase", F.lit("syndyk").alias("seller_type"), F.coalesce(clean(F.col("signatureOfCase")), numbers.case_number(entity)).alias("case_number"), entity.alias("location_text"), text.property_type(entity, F.col("phrase")).alias("property_type"))


def notices_by_word(landed: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Notices of an insolvency register, one a line, that tell of a sale."""
    row = "id string, numerObwieszczenia string, tytul string, rodzajObwieszczenia string, tresc string, opis string, cenaWywolawcza string, wartoscOszacowania string, wadium string, sygnatura string, syndyk string, miejscowosc string"
    r = landed.select(*keep, F.from_json(body, row).alias("r")).select(*keep, "r.*")
    title, content = text.clean(F.coalesce("tytul", "rodzajObwieszczenia")), text.clean(F.coalesce("tresc", "opis"))
    rows = r.withColumns({"title": F.coalesce(F.nullif(title, F.lit("")), F.substring(content, 1, 160)), "content": content, "key": F.coalesce("id", "numerObwieszczenia")})
    rows = rows.where(F.concat_ws(" ", "title", "content").rlike(SALE_WORDS) & F.col("key").isNotNull())
    price = numbers.parse_number(F.col("cenaWywolawcza"))
    return rows.select(*keep, F.col("key").alias("external_id"), F.lit("licytacja").alias("kind"), F.substring("title", 1, 400).alias("title"), F.nullif("content", F.lit("")).alias("description"), price.alias("price"), price.alias("opening_price"), numbers.parse_number(F.col("wartoscOszacowania")).alias("estimate_value"), numbers.parse_number(F.col("wadium")).alias("deposit"), F.coalesce(clean(F.col("sygnatura")), numbers.case_number(F.col("content"))).alias("case_number"), F.lit("syndyk").alias("seller_type"), clean(F.col("miejscowosc")).alias("city"), numbers.area(F.col("content")).alias("area"), text.property_type(F.col("title"), F.col("content")).alias("property_type"))


def tenders(landed: DataFrame, province: str, cpv: tuple[str, ...] = (), skipped: tuple[str, ...] = (), body: str = "value") -> DataFrame:
    """Public tenders ({items: [...]}) of a province (its code), of notice types that are not ``skipped``, whose CPV code, if they
    have one, begins with one of ``cpv``."""
    row = "struct<noticeNumber:string,bzpNumber:string,orderObject:string,cpvCode:string,organizationProvince:string,organizationName:string,organizationCity:string,noticeType:string,orderValue:string,submittingOffersDate:string>"
    r = landed.select(F.explode(F.from_json(body, f"struct<items:array<{row}>>")["items"]).alias("r")).select("r.*")
    code = F.coalesce("cpvCode", F.lit(""))
    fits = (code == "") | F.lit(False) if cpv else F.lit(True)
    for prefix in cpv:
        fits = fits | code.startswith(prefix)
    number = F.coalesce("noticeNumber", "bzpNumber")
    rows = r.where((F.col("organizationProvince") == province) & ~F.coalesce(F.col("noticeType").isin(*skipped), F.lit(False)) & fits & number.isNotNull() & (F.length(F.trim("orderObject")) > 0))
    return rows.select(number.alias("external_id"), F.lit("przetarg").alias("kind"), F.substring(text.clean(F.col("orderObject")), 1, 400).alias("title"), numbers.parse_number(F.col("orderValue")).alias("price"), clean(F.col("organizationName")).alias("authority"), F.lit("urzad").alias("seller_type"), clean(F.col("organizationCity")).alias("city"), F.nullif(code, F.lit("")).alias("cpv"))


def agency_directory(landed: DataFrame, html: str = "html") -> DataFrame:
    """Active agencies in the embedded JSON of a directory's pages, each once: name, slug, region, phone and listings."""
    items = landed.select(F.explode(items_in(pages.next_data(F.col(html)), ("name", "location", "statistics"))).alias("item"))
    schema = "id string, name string, status string, attributes struct<slug:string>, location struct<fullName:string>, contacts struct<phone:string>, statistics struct<adsSell:struct<activeAdsCount:int>,adsRent:struct<activeAdsCount:int>>"
    a = items.select(F.from_json("item", schema).alias("a")).where((F.length(F.trim("a.name")) > 0) & (F.upper(F.coalesce("a.status", F.lit("ACTIVE"))) == "ACTIVE"))
    place = text.clean(F.col("a.location.fullName"))
    count = lambda c: F.coalesce(f"a.statistics.{c}.activeAdsCount", F.lit(0))
    rows = a.select(F.coalesce("a.id", "a.attributes.slug", "a.name").alias("external_id"), text.clean(F.col("a.name")).alias("name"), F.col("a.attributes.slug").alias("slug"), F.when(place.contains(","), F.trim(F.element_at(F.split(place, ","), -1))).alias("voivodeship"), clean(F.col("a.contacts.phone")).alias("phone"), (count("adsSell") + count("adsRent")).alias("expected"))
    return rows.groupBy("external_id").agg(*(F.min(c).alias(c) for c in rows.columns if c != "external_id"))


def card_address(cards: DataFrame, units: DataFrame, regions: list[str], address: str = "address", card: str = "id") -> DataFrame:
    """Parts of an address ("street, district, town, county, region" in whatever number and order) told apart by the registry:
    the last part may be a region, then a county; the town is the last part that the registry has as town or commune, or else
    the last one; what is left is the district, and before it the street. ``card`` has to be unique."""
    from kadastra.operators.locate import known_region

    parts = F.filter(F.transform(F.split(F.coalesce(F.col(address), F.lit("")), ","), text.clean), lambda p: p != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    most = lambda a, n: F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))
    rows = cards.select(F.col(card).alias("card"), parts.alias("parts")).withColumn("region", known_region(last(F.col("parts")), regions))
    rows = rows.withColumn("parts", F.when(F.col("region").isNotNull(), most(F.col("parts"), 1)).otherwise(F.col("parts")))
    known = places.known(units).select("unit_key", (F.col("unit_kind") == "powiat").alias("is_county")).groupBy("unit_key").agg(F.max("is_county").alias("is_county"), F.max(~F.col("is_county")).alias("is_place"))
    each = rows.select("card", F.posexplode("parts").alias("at", "part")).join(places.small(known), places.name_key(F.col("part")) == F.col("unit_key"))
    found = each.groupBy("card").agg(F.collect_set(F.when(F.col("is_county") & ~F.col("is_place"), F.col("at"))).alias("counties"), F.sort_array(F.collect_set(F.when(F.col("is_place"), F.col("at"))), False).alias("towns"))
    rows = rows.join(found, "card", "left")
    is_county = F.coalesce(F.array_contains("counties", F.size("parts") - 1), F.lit(False))
    rows = rows.withColumn("county", F.when(is_county, last(F.col("parts")))).withColumn("parts", F.when(is_county, most(F.col("parts"), 1)).otherwise(F.col("parts")))
    town = F.coalesce(F.get(F.filter("towns", lambda i: i < F.size("parts")), 0), F.size("parts") - 1)
    rows = rows.withColumn("town_at", town).withColumn("city", F.get("parts", F.when(F.col("town_at") >= 0, F.col("town_at"))))
    rows = rows.withColumn("rest", F.filter("parts", lambda p, i: i != F.col("town_at")))
    return rows.select(F.col("card").alias(card), F.col("region").alias("voivodeship"), "county", "city", last(F.col("rest")).alias("district"), F.nullif(F.array_join(most(F.col("rest"), 1), ", "), F.lit("")).alias("street"))
