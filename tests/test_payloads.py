"""Readers of landed payloads and the repairs that need a registry."""

import datetime as dt
import json

from pyspark.sql import functions as F

from kadastra.operators import duplicates, repair
from kadastra.plans import sample_places
from kadastra.sources import payloads


def next_page(data):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script></html>'


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_portal_offers_wherever_the_list_is(spark):
    item = {
        "id": 7, "slug": "dom-ID1", "title": " Dom  z ogrodem ", "totalPrice": {"value": 500000}, "areaInSquareMeters": 120.5, "roomsNumber": "THREE", "floorNumber": "GROUND", "market": "SECONDARY", "isPrivateOwner": True, "dateCreated": "2026-09-21 19:13:17",
        "location": {"reverseGeocoding": {"locations": [{"locationLevel": "voivodeship", "name": "opolskie"}, {"locationLevel": "county", "name": "nyski"}, {"locationLevel": "city_or_village", "name": "Nysa"}, {"locationLevel": "city_or_village", "name": "Inna"}]}, "address": {"city": {"name": "X"}, "street": {"name": "Rynek"}}, "coordinates": {"latitude": 50.4, "longitude": 17.3}},
        "images": [{"medium": "m"}, {"large": "l", "small": "s"}, {}],
    }
    hidden = {"id": 8, "slug": "b", "title": "Biuro", "totalPrice": {"value": 1}, "hidePrice": True, "agency": {"name": "Biuro A", "type": "AGENCY"}, "floorNumber": "FLOOR_4"}
    page = next_page({"props": {"pageProps": {"deep": [{"wrong": [{"slug": "x"}]}, {"data": {"searchAds": {"items": [item, hidden, {"slug": "", "title": "t"}]}}}]}}})
    rows = {r.external_id: r for r in payloads.portal_offers(spark.createDataFrame([(page,), (None,), ("<p>",), (next_page([]),)], "html string"), base="https://x.pl/").collect()}
    r, h = rows["7"], rows["8"]
    assert len(rows) == 2 and (r.title, r.price, r.area, r.rooms, r.floor, r.market, r.seller_type) == ("Dom z ogrodem", 500000.0, 120.5, 3, 0, "wtorny", "prywatna")
    assert (r.voivodeship, r.county, r.city, r.street, r.lat, r.images, r.url) == ("opolskie", "nyski", "Nysa", "Rynek", 50.4, ["m", "l"], "https://x.pl/dom-ID1")
    assert r.published_at == dt.datetime(2026, 9, 21, 17, 13, 17) and (h.price, h.floor, h.seller_type, h.seller_name) == (None, 4, "posrednik", "Biuro A")


def test_state_offers_with_a_wrong_zone(spark):
    row = {"id": "1", "slug": "s", "name": "Mieszkanie", "deal_type": "rent", "price": {"total": "2 500"}, "property": {"type": "apartment", "size": "67.31", "room_number": 3, "floors": {"floor": 2, "building_floors": "4"}, "address_details": {"city": "Opole", "street": "ul. Sieradzka"}}, "agent": {"name": "Jan", "last_name": "Kot", "phone_number": "600100200"}, "created_at": "2026-09-12T20:31:07Z", "market_type": "primary_market"}
    html = f"<script>window.__INITIAL_STATE__ = {json.dumps({'offerList': {'offers': {'offers': [row, {'slug': '', 'name': 'x'}]}}})};</script>"
    r = one(payloads.state_offers(spark.createDataFrame([(html,), (None,)], "html string")))
    assert (r.price, r.area, r.rooms, r.floor, r.floors_total, r.street, r.phones_raw, r.seller_name, r.seller_type, r.transaction) == (2500.0, 67.31, 3, 2, 4, "Sieradzka", ["600100200"], "Jan Kot", "posrednik", "wynajem")
    assert r.published_at == dt.datetime(2026, 9, 12, 18, 31, 7)


def test_official_auctions(spark):
    rows = [{"uuid": "a", "title": "Lokal 45 m2 w Opolu", "startingPrice": "100000", "saleBeginDateTime": "2026-10-12T10:00:00", "localization": "Opole"}, {"uuid": "b", "title": "x", "cancellationDateTime": "2026-01-01"}, {"uuid": "a", "title": "Lokal 45 m2 w Opolu"}, {"title": "bez id"}]
    got = payloads.official_auctions(spark.createDataFrame([(json.dumps({"content": rows}),), ("kaput",)], "value string")).collect()
    assert [(r.external_id, r.area, r.kind) for r in got] == [("a", 45.0, "licytacja")]


def test_bailiff_auctions(spark):
    card = lambda i, mode: f'<a class="card auction" href="/licytacje/{i}/x"><div class="auction__tags"><span class="v-chip__content">Mieszkania</span><span class="v-chip__content">{mode}</span></div><h3 class="auction__title">Lokal Km 12/24</h3><div class="auction__price"><b>Cena wywołania</b> 75 000,00 zł</div><div class="auction__price">Suma oszacowania 100 000,00 zł</div><div class="auction__row--location">opolskie Nysa</div></a>'
    landed = spark.createDataFrame([(card(5, "Licytacja elektroniczna") + card(6, "stacjonarna") + '<a class="auction" href="/inne">x</a>',), (None,)], "html string")
    rows = {r.external_id: r for r in payloads.bailiff_auctions(landed).collect()}
    assert set(rows) == {"5", "6"} and (rows["5"].opening_price, rows["5"].estimate_value, rows["5"].deposit, rows["5"].case_number) == (75000.0, 100000.0, 10000.0, "Km 12/24")
    assert one(payloads.bailiff_auctions(landed, electronic=True)).external_id == "5"


def test_notices_and_tenders(spark):
    found = [("grunt", json.dumps({"list": [{"id": 1, "entityName": "Spółka X", "monitorNumber": "10/2026", "signatureOfCase": "V GUp 1/26"}, {"id": 2, "entityName": ""}]})), ("działka", json.dumps({"list": [{"id": 1, "entityName": "Spółka X", "monitorNumber": "10/2026"}]}))]
    r = one(payloads.notices_by_phrase(spark.createDataFrame(found, "phrase string, value string")))
    assert (r.external_id, r.phrase, r.title, r.seller_type) == ("1", "działka", "Obwieszczenie MSiG 10/2026: Spółka X", "syndyk")
    lines = [json.dumps(x) for x in ({"id": "k1", "tytul": "Sprzedaż nieruchomości", "tresc": "Dom 120 m2, sygn. Km 5/25", "cenaWywolawcza": "300 000", "wadium": "30 000"}, {"id": "k2", "tytul": "Ogłoszenie upadłości", "tresc": "bez majątku"}, {"tytul": "przetarg"})]
    r = one(payloads.notices_by_word(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert (r.external_id, r.price, r.deposit, r.area, r.case_number, r.property_type) == ("k1", 300000.0, 30000.0, 120.0, "Km 5/25", "dom")
    items = [{"noticeNumber": f"n{i}", "orderObject": "Budowa", "cpvCode": c, "organizationProvince": p, "noticeType": t} for i, (c, p, t) in enumerate([("45000000-7", "PL52", "A"), ("70000000-1", "PL52", "A"), (None, "PL52", "A"), ("45000000-7", "PL51", "A"), ("45000000-7", "PL52", "Z")])]
    got = payloads.tenders(spark.createDataFrame([(json.dumps({"items": items}),)], "value string"), "PL52", ("45",), ("Z",)).collect()
    assert sorted(r.external_id for r in got) == ["n0", "n2"]


def test_agency_directory(spark):
    row = lambda i, **more: {"id": i, "name": f"Biuro {i}", "location": {"fullName": "Kraków, małopolskie"}, "statistics": {"adsSell": {"activeAdsCount": 3}, "adsRent": {"activeAdsCount": 4}}, "attributes": {"slug": f"b{i}"}, "contacts": {"phone": " 12 300 40 50 "}, **more}
    page = next_page({"a": {"b": {"accounts": [row(1), row(2, status="DELETED")], "pagination": {"hasNext": False}}}})
    r = one(payloads.agency_directory(spark.createDataFrame([(page,), (page,)], "html string")))
    assert (r.external_id, r.name, r.slug, r.voivodeship, r.phone, r.expected) == ("1", "Biuro 1", "b1", "małopolskie", "12 300 40 50", 7)


def test_card_addresses(spark):
    rows = [(1, "Rynek, Śródmieście, Opole, opolskie"), (2, "Biestrzykowice, Świerczów, namysłowski"), (3, "Florynka"), (4, "Nysa, nyski, opolskie"), (5, None), (6, "opolskie")]
    got = {r.id: (r.voivodeship, r.county, r.city, r.district, r.street) for r in payloads.card_address(spark.createDataFrame(rows, "id long, address string"), sample_places.units(spark), ["opolskie", "pomorskie"]).collect()}
    assert got == {1: ("opolskie", None, "Opole", "Śródmieście", "Rynek"), 2: (None, "namysłowski", "Świerczów", "Biestrzykowice", None), 3: (None, None, "Florynka", None, None), 4: ("opolskie", "nyski", "Nysa", None, None), 5: (None,) * 5, 6: ("opolskie",) + (None,) * 4}


PLACE = "id long, source_key string, title string, city string, county string, commune string, voivodeship string, district string, street string, teryt string, lat double, lon double, geo_precision string"


def places_of(df):
    return {r.id: (r.city, r.county, r.voivodeship, r.lat) for r in df.collect()}


def test_repairs_of_places(spark):
    units = sample_places.units(spark)
    rows = spark.createDataFrame(
        [(1, "urzad", "t", "Opole", None, None, None, None, None, None, 1.0, 2.0, "city"), (2, "urzad", "t", "Osiek", "starogardzki", None, None, None, None, None, None, None, None), (3, "urzad", "t", "Osiek", None, None, None, None, None, None, None, None, None), (4, "urzad", "t", None, None, None, None, None, None, None, None, None, None)],
        PLACE,
    )
    assert places_of(repair.regions_of_places(rows, units)) == {1: ("Opole", "Opole", "opolskie", 1.0), 2: ("Osiek", "starogardzki", "pomorskie", None), 3: ("Osiek", None, None, None), 4: (None, None, None, None)}
    rows = spark.createDataFrame([(1, "urzad", "Lokal w Sopocie", "Nysa", "nyski", None, "opolskie", None, None, None, 1.0, 2.0, "city"), (2, "portal", "Lokal w Sopocie", "Nysa", "nyski", None, "opolskie", None, None, None, 1.0, 2.0, "city"), (3, "urzad", "Dobra oferta", "Nysa", "nyski", None, "opolskie", None, None, None, 1.0, 2.0, "city"), (4, "urzad", "Dom w Nysie", "Nysa", "nyski", None, "opolskie", None, None, None, 1.0, 2.0, "city")], PLACE)
    once = repair.relocate_by_title(rows, units, ["portal"])
    want = {1: ("Sopot", "Sopot", "pomorskie", None), 2: ("Nysa", "nyski", "opolskie", 1.0), 3: ("Nysa", "nyski", "opolskie", 1.0), 4: ("Nysa", "nyski", "opolskie", 1.0)}
    assert places_of(once) == want and places_of(repair.relocate_by_title(once, units, ["portal"])) == want
    addresses = spark.createDataFrame([(1, "Gdańsk", "pomorskie"), (3, "Nysa", "opolskie"), (4, " ", None)], "id long, city string, voivodeship string")
    assert places_of(repair.relocate_by_address(rows, addresses, units)) == {1: ("Gdańsk", "Gdańsk", "pomorskie", None), 2: want[2], 3: want[3], 4: want[4]}
    rows = spark.createDataFrame([(1, "gratka", "t", None, "namysłowski", None, None, "Świerczów", "Biestrzykowice", None, 1.0, 1.0, "city"), (2, "gratka", "t", None, None, None, None, "Nigdzie", None, None, 1.0, 1.0, "city")], PLACE)
    got = {r.id: (r.city, r.county, r.district, r.street, r.lat) for r in repair.restore_city(rows, units, ["gratka"]).collect()}
    assert got == {1: ("Świerczów", "namysłowski", "Biestrzykowice", None, None), 2: (None, None, "Nigdzie", None, 1.0)}
    boxes = spark.createDataFrame([("opolskie", 50.0, 51.0, 17.0, 18.5), ("pomorskie", 53.5, 54.9, 16.7, 19.6)], "voivodeship string, lat_min double, lat_max double, lon_min double, lon_max double")
    base = lambda i, city, teryt, lat, lon: (i, "x", "t", city, "c", None, "opolskie", None, None, teryt, lat, lon, None)
    rows = spark.createDataFrame([base(1, "Opole", "166101", None, None), base(2, "Sopot", "226401", None, None), base(3, "X", None, 54.0, 18.0), base(4, "X", None, 50.5, 18.0), base(5, "Sopot", None, None, None), base(6, "Osiek", None, None, None), base(7, "Nysa", None, None, None)], PLACE)
    got = {r.id: (r.voivodeship, r.county) for r in repair.default_region(rows, units, boxes).collect()}
    assert got == {1: ("opolskie", "c"), 2: ("pomorskie", None), 3: ("pomorskie", None), 4: ("opolskie", "c"), 5: ("pomorskie", None), 6: (None, None), 7: ("opolskie", "c")}


def test_links_and_dates_are_looked_at_again(spark):
    rows = spark.createDataFrame([(1, "a", "Dom", 100.0, "Opole", 500000.0, "p"), (2, "b", "Dom", 100.5, "Opole", 500000.0, "p"), (3, "c", "Dom", 100.0, "Opole", 900000.0, "p")], "id long, source_key string, title string, area double, city string, price double, phone_fingerprint string").withColumns({"kind": F.lit("nieruchomosc"), "transaction": F.lit("sprzedaz"), "property_type": F.lit("dom"), "first_seen": F.lit(None).cast("timestamp")})
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 99)], "original_id long, copy_id long")
    assert [(r.original_id, r.copy_id, r.method) for r in repair.recheck_links(duplicates.fingerprints(rows), links).collect()] == [(1, 2, "phone")]
    raw = [(1, "a", '{"jsonld": {"datePosted": "2026-09-12T10:00:00"}}'), (2, "a", "{}"), (3, "b", '{"when": "2026-10-12T10:00:00Z"}'), (4, "c", '{"when": "2026-10-12T10:00:00Z"}')]
    df = spark.createDataFrame([(*r, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1)) for r in raw], "id long, source_key string, raw string, published_at timestamp_ntz, event_date timestamp_ntz")
    again = repair.dates_from_raw(df, F.lit("2026-10-01").cast("timestamp"), {"a": {"published_at": ["datePosted", "jsonld.datePosted"]}, "b": {"event_date": ["when"]}}, local=("event_date",), naive_local=("a",))
    got = {r.id: (r.published_at, r.event_date) for r in again.collect()}
    old = dt.datetime(2020, 1, 1)
    assert got == {1: (dt.datetime(2026, 9, 12, 8), old), 2: (old, old), 3: (old, dt.datetime(2026, 10, 12, 12)), 4: (old, old)}
