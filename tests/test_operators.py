"""Operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kadastra.operators import agencies, alerts, duplicates, graph, locate, market, normalize, places, repair, search, similar, skew, stats, upsert
from kadastra.operators.search import Filters
from kadastra.plans import sample_places

NOW = "2026-09-30 12:00:00"


def test_filters_from_query():
    f = Filters.from_query({"price_max": "300 000,5", "rooms_min": "x", "source": ["a", "b"], "page": "0", "per_page": "900", "only_active": ["0", "1"], "nonsense": "1"})
    assert (f.price_max, f.rooms_min, f.source, f.page, f.per_page, f.only_active) == (300000.5, None, ("a", "b"), 1, 100, True)
    assert search.active_filters(f) == [("source", ("a", "b")), ("price_max", 300000.5)]
    assert search.indexable(Filters(city="Opole"), 3) and not search.indexable(f, 3) and not search.indexable(Filters(), 0)


def test_streets(spark):
    rows = spark.createDataFrame([(1, "Łódzka 12"), (2, "Jana Pawła II"), (3, "Ozimskiej"), (4, "Czesława Miłosza, Kleczków"), (5, None)], "id int, street string")
    ids = lambda s: [r.id for r in rows.where(search.street_clause(F.col("street"), s)).collect()]
    assert ids("ul. Łódzka") == [1] and ids("Pawła II") == [2] and ids("Ozimska") == [3] and ids("Miłosza Czesława") == [4]
    assert search.street_clause(F.col("street"), "") is None


def test_known_places_match_exactly(spark):
    rows = spark.createDataFrame([("Opole",), ("Opole Lubelskie",), ("Ópole",)], "city string")
    assert rows.where(search.place_clause(F.col("city"), "Opole", {"Opole": ["Opole"]})).count() == 1
    assert rows.where(search.place_clause(F.col("city"), "opole")).count() == 3


def _market(spark, n, price, city="A", **more):
    row = {"property_type": "mieszkanie", "transaction": "sprzedaz", "status": "aktywna", "county": "P", "voivodeship": "W", "is_original": True} | more
    return spark.createDataFrame([(i, price + i, city) for i in range(n)], "id long, price_per_m2 double, city string").select("*", *(F.lit(v).alias(k) for k, v in row.items()))


def test_market_falls_back_to_wider_levels(spark):
    rows = _market(spark, 10, 1000.0).unionByName(_market(spark, 2, 500.0, "B").withColumn("id", F.col("id") + 100))
    scored = {r.id: r for r in market.score(rows).collect()}
    assert scored[0].deal_level == "miasto" and scored[100].deal_level == "powiat"
    assert scored[100].deal_ratio == pytest.approx(500 / 1003.5, abs=0.001)
    assert market.medians(rows).count() == 3
    few = market.score(_market(spark, 3, 1000.0))
    assert few.where("deal_ratio is not null").count() == 0
    assert market.score(rows.limit(0)).count() == 0


def test_kiosks_and_lodgings_are_not_compared(spark):
    rows = [(i, "aktywna", "dom", "sprzedaz", "Opole", "Opole", "opolskie", 5000.0 + i, title) for i, title in enumerate(["Dom z ogrodem"] * 8 + ["Domek holenderski", "Kiosk przy dworcu", "Noclegi dla firm", None])]
    df = spark.createDataFrame(rows, "id long, status string, property_type string, transaction string, city string, county string, voivodeship string, price_per_m2 double, title string")
    assert {r.n for r in market.medians(df).collect()} == {9}
    assert {r.id for r in market.score(df).where("deal_ratio is null").collect()} == {8, 9, 10}


def test_a_suspicious_ratio_is_no_bargain(spark):
    rows = _market(spark, 10, 1000.0).unionByName(_market(spark, 1, 100.0).withColumn("id", F.lit(99).cast("long")))
    assert market.score(rows).where("id = 99").first().deal_ratio is None


OFFER = {
    "id": 1, "source_key": "a", "kind": "nieruchomosc", "transaction": "sprzedaz", "property_type": "mieszkanie", "title": "Mieszkanie", "description": "", "city": "Opole",
    "street": None, "area": 49.0, "rooms": 2, "floor": None, "price": 300000.0, "case_number": None, "opening_price": None, "event_date": None, "phone_fingerprint": None,
    "first_seen": dt.datetime(2026, 1, 2), "published": None, "seller_type": "nieznany",
}
BODY = "Ładne i jasne mieszkanie w centrum miasta blisko parku i szkoły z dużym balkonem oraz piwnicą do wprowadzenia od zaraz polecam"


def links(spark, a, b):
    rows = spark.createDataFrame([tuple((OFFER | a | {"id": 1}).values()), tuple((OFFER | {"source_key": "b"} | b | {"id": 2}).values())], ", ".join(f"{k} {t}" for k, t in duplicates.COLUMNS.items()))
    rows = rows.select(*OFFER)
    return duplicates.verdicts(duplicates.candidate_pairs(duplicates.fingerprints(rows))).collect()


OFFER = {k: OFFER[k] for k in duplicates.COLUMNS}


@pytest.mark.parametrize(
    "a, b, linked",
    [
        ({"street": "Polna"}, {"street": "Polna"}, True),
        ({"description": BODY}, {"description": BODY, "title": "Mieszkanie"}, True),
        ({"title": "Kawalerka pierwsza"}, {"title": "Lokum inne zupełnie"}, False),
        ({"description": BODY, "price": 669312.0, "source_key": "b"}, {"description": BODY, "price": 678163.0}, False),
        ({"street": "Polna", "title": "Mieszkanie nr 23"}, {"street": "Polna", "title": "Mieszkanie nr 29"}, False),
        ({"street": "Polna"}, {"street": "Leśna", "title": "Mieszkanie"}, False),
        ({"street": "Polna", "price": 300000.0}, {"street": "Polna", "price": 700000.0}, False),
        ({"phone_fingerprint": "x", "area": None}, {"phone_fingerprint": "x", "area": None}, False),
        ({"phone_fingerprint": "x"}, {"phone_fingerprint": "x", "area": 50.2, "rooms": 3}, True),
        ({"kind": "licytacja", "case_number": "Km 1/23"}, {"kind": "licytacja", "case_number": "Km 1/23"}, True),
        ({"kind": "licytacja", "opening_price": 69750.0}, {"kind": "licytacja", "opening_price": 334000.0}, False),
        ({"kind": "przetarg", "street": "Polna"}, {"kind": "przetarg", "street": "Polna"}, False),
        ({"floor": 3, "street": None}, {"floor": None, "street": "Polna", "title": "Mieszkanie"}, True),
    ],
)
def test_duplicate_pairs(spark, a, b, linked):
    assert bool(links(spark, a, b)) is linked


def test_a_hot_key_makes_no_clique(spark):
    """Twenty thousand copies of one offer on many days: links in proportion to the copies, groups as from all pairs."""
    n = 20_000
    rows = spark.range(n).select(
        "id", F.concat(F.lit("src"), F.col("id") % 7).alias("source_key"), F.lit("nieruchomosc").alias("kind"), F.lit("sprzedaz").alias("transaction"), F.lit("mieszkanie").alias("property_type"), F.lit("Ta sama oferta").alias("title"),
        F.lit("opis " * 60).alias("description"), F.lit("Opole").alias("city"), F.lit("Rynek").alias("street"), F.lit(50.0).alias("area"), F.lit(3).alias("rooms"), F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("floor"), F.lit(400000.0).alias("price"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 9_000).alias("first_seen"), F.lit("prywatna").alias("seller_type"),
    )
    found = duplicates.fingerprints(rows)
    pairs = duplicates.candidate_pairs(found).checkpoint()
    assert n - 100 < pairs.count() < 2 * n
    links = duplicates.verdicts(pairs).checkpoint()
    got = duplicates.groups(found, links, lambda d: d.checkpoint()).groupBy("floor").agg(F.count_if("is_original").alias("originals"), F.max("copies_count").alias("copies")).collect()
    assert sorted((r.floor, r.originals, r.copies) for r in got) == [(1, 1, n // 2 - 1), (2, 1, n // 2 - 1)]


def test_upper_medians(spark):
    random.seed(1)
    rows = [(k, float(random.choice((random.randrange(500), 10_000 + random.randrange(300_000))))) for k in "abc" for _ in range(random.randrange(1, 400))] + [(None, 5.0), ("d", None)]
    want = {k: sorted(v for x, v in rows if x == k and v is not None) for k in ("a", "b", "c", None)}
    got = {r.k: r.upper_median for r in stats.upper_medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {k: v[len(v) // 2] for k, v in want.items()}


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 3), "posrednik"), (2, dt.datetime(2026, 1, 2), "posrednik"), (3, dt.datetime(2026, 1, 2), "prywatna"), (4, dt.datetime(2026, 1, 1), "x")], "id long, first_seen timestamp, seller_type string").withColumn("published", F.lit(None).cast("timestamp"))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a_id long, b_id long")
    found = {r.id: r for r in duplicates.groups(rows, edges, lambda d: d.checkpoint()).collect()}
    assert found[3].is_original and found[3].copies_count == 2 and found[1].duplicate_of_id == 3 and found[4].is_original


def test_components_match_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long"), lambda d: d.checkpoint()).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long"), lambda d: d.checkpoint()).count() == 0


def test_join_with_a_hot_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert skew.join_groups(rows, groups, "k", "n").where("k = 0 and top = 3999").count() == 4000
    assert skew.join_groups(rows, groups, "k", "n").count() == 5000


def test_upsert_keeps_what_a_batch_leaves_out(spark):
    stamp = dt.datetime(2026, 9, 1)
    kinds = "id long, source_key string, external_id string, kind string, price double, initial_price double, city string, street string, status string, lat double, lon double, geo_precision string, event_date timestamp, first_seen timestamp, last_seen timestamp"
    current = spark.createDataFrame([(1, "a", "1", "nieruchomosc", 100.0, None, "Opole", "Polna", "nieaktywna", 50.0, 18.0, "street", None, stamp, stamp), (2, "a", "2", "licytacja", 5.0, None, "Opole", None, "nieaktywna", None, None, None, dt.datetime(2026, 9, 25), stamp, stamp)], kinds)
    batch = spark.createDataFrame([("a", "1", "nieruchomosc", 90.0, "", "Leśna", []), ("a", "2", "licytacja", 5.0, "Opole", None, []), ("b", "7", "nieruchomosc", 7.0, "Nysa", None, [])], "source_key string, external_id string, kind string, price double, city string, street string, cleared array<string>")
    merged = {(r.source_key, r.external_id): r for r in upsert.upsert(current, batch, F.lit(NOW).cast("timestamp")).collect()}
    one, two, new = merged["a", "1"], merged["a", "2"], merged["b", "7"]
    assert (one.change, one.city, one.street, one.lat, one.status, one.initial_price) == ("updated", "Opole", "Leśna", None, "aktywna", 100.0)
    assert (two.change, two.status) == ("unchanged", "nieaktywna")
    assert (new.change, new.status, new.initial_price) == ("new", "aktywna", 7.0) and new.id is not None
    clear = batch.where("external_id = '1'").withColumn("cleared", F.array(F.lit("price"))).withColumn("price", F.lit(None).cast("double"))
    assert upsert.upsert(current, clear, F.lit(NOW).cast("timestamp")).where("id = 1").first().price is None


def test_missing_after_three_days(spark):
    rows = spark.createDataFrame([(1, "a", "aktywna", dt.datetime(2026, 9, 30, 10)), (2, "a", "aktywna", dt.datetime(2026, 9, 26)), (3, "b", "aktywna", dt.datetime(2026, 9, 1))], "id long, source_key string, status string, last_seen timestamp")
    found = {r.id: r.status for r in upsert.mark_missing(rows, F.lit(NOW).cast("timestamp"), ["a"]).collect()}
    assert found == {1: "aktywna", 2: "nieaktywna", 3: "aktywna"}


def test_copies_of_a_deleted_original_become_originals(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, 1), (3, False, 9)], "id long, is_original boolean, duplicate_of_id long")
    left = {r.id: r for r in upsert.delete(rows, rows.where("id = 1")).collect()}
    assert set(left) == {2, 3} and left[2].is_original and left[2].duplicate_of_id is None and left[3].duplicate_of_id == 9


def test_repairs_are_idempotent(spark):
    rows = spark.createDataFrame([(1, 0.0, 30.0, "Polecane nieruchomości", "dom", "aktywna", 10.0, 10.0), (2, 5e5, 12743.0, "Mieszkanie 127,43 m2", "mieszkanie", "aktywna", 50.0, 18.0), (3, None, None, None, None, "aktywna", None, None)], "id long, price double, area double, title string, property_type string, status string, lat double, lon double")
    once = repair.all_passes(rows)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, repair.all_passes(once).collect()), key=str)
    found = {r.id: r for r in once.collect()}
    assert found[1].price is None and found[1].status == "archiwalna" and found[1].lat is None and found[2].area == 127.43


def test_similar_offers(spark):
    base = {"kind": "nieruchomosc", "property_type": "mieszkanie", "transaction": "sprzedaz", "status": "aktywna", "is_original": True, "city": "Opole", "county": "Opole", "voivodeship": "opolskie", "lat": None, "lon": None, "district": None}
    rows = [(1, 500000.0, 50.0, 2, {}), (2, 520000.0, 52.0, 2, {}), (3, 600000.0, 60.0, 3, {}), (4, 900000.0, 50.0, 2, {}), (5, 500000.0, 120.0, 2, {}), (6, 500000.0, 51.0, 2, {"transaction": "wynajem"}), (7, 500500.0, 50.2, 2, {}), (8, 510000.0, 50.0, 2, {"status": "nieaktywna"}), (9, 520100.0, 52.3, 2, {})]
    kinds = "id long, price double, area double, rooms int, kind string, property_type string, transaction string, status string, is_original boolean, city string, county string, voivodeship string, lat double, lon double, district string"
    df = spark.createDataFrame([(i, p, a, r, *(base | m).values()) for i, p, a, r, m in rows], kinds)
    found = [(r.id, r.place) for r in similar.similar(df, df.where("id = 1"), lambda d: d.checkpoint()).orderBy("place").collect()]
    assert found == [(2, 1), (3, 2)]


def test_agency_match(spark):
    names = spark.createDataFrame([("Dom-Opole Nieruchomości", "Opole"), ("Zupełnie Inne", "Nysa")], "name string, city string")
    known = spark.createDataFrame([(7, "Nieruchomości Dom Opole", "Opole", "x"), (8, "Zupa", "Nysa", "y")], "id long, name string, city string, slug string")
    assert [(r.agency_id, r.score) for r in agencies.match(names, known).collect()] == [(7, 100.0)]


def test_places_in_texts(spark):
    docs = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(sample_places.TEXTS)] + [(98, None), (99, "")], "id long, text string")
    found = {r.id: r.teryt for r in locate.find_places(docs, sample_places.units(spark)).collect()}
    assert found == {i: teryt for i, (_, teryt) in enumerate(sample_places.TEXTS)} | {98: None, 99: None}


def test_named_places_are_looked_up(spark):
    units = sample_places.units(spark)
    asked = spark.createDataFrame([("Osiek", None), ("osiek", "pomorskie"), ("Kraków, Podgórze", None), ("Nigdzie", None), ("Opole", "śląskie"), ("opolskie", None), (None, "opolskie")], "place string, hint string")
    got = {(r.place, r.hint): r.teryt for r in places.resolve(asked, units).collect()}
    assert got == {("Osiek", None): None, ("osiek", "pomorskie"): "221303", ("Kraków, Podgórze", None): "126101", ("Nigdzie", None): None, ("Opole", "śląskie"): "166101", ("opolskie", None): None, (None, "opolskie"): None}


def test_where_offers_lie(spark):
    """Portal before registry before text; the point tells regions apart; a region in the town field is no town."""
    boxes = spark.createDataFrame([("małopolskie", 49.2, 50.5, 19.1, 21.4), ("świętokrzyskie", 50.0, 51.3, 19.7, 21.9), ("pomorskie", 53.5, 54.9, 16.7, 19.6)], "voivodeship string, lat_min double, lat_max double, lon_min double, lon_max double")
    rows = [
        (1, "OPOLSKIE", None, "Opole", None, None, None, None, None),
        (2, None, None, "Osiek", None, None, None, 50.003, 20.105),
        (3, None, None, "pomorskie", "Mieszkanie w Sopocie", None, None, None, None),
        (4, None, "namysłowski", None, "Ładna działka", "gm. Pokój", None, None, None),
        (5, None, None, "Florynka", "Dom w Krakowie", None, None, None, None),
        (6, None, None, None, "Dobra oferta", None, "Dom w miejscowości Dobra, gm. Dobra", None, None),
        (7, None, None, None, "Działka, woj. opolskie", None, "Dąbrowa, blisko lasu", None, None),
        (8, None, None, None, None, None, None, None, None),
        (9, None, "krakowski", "Kraków", None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "id long, voivodeship string, county string, city string, title string, location_text string, description string, lat double, lon double")
    got = {r.id: (r.voivodeship, r.county, r.city, r.origin) for r in locate.where_it_lies(raw, sample_places.units(spark), boxes).collect()}
    assert got == {
        1: ("opolskie", "Opole", "Opole", "rejestr"), 2: ("małopolskie", "oświęcimski", "Osiek", "rejestr"), 3: ("pomorskie", "Sopot", "Sopot", "tekst"), 4: ("opolskie", "namysłowski", "Pokój", "tekst"),
        5: (None, None, "Florynka", "portal"), 6: ("zachodniopomorskie", "łobeski", "Dobra", "tekst"), 7: ("opolskie", "opolski", "Dąbrowa", "tekst"), 8: (None, None, None, "brak"), 9: ("małopolskie", "krakowski", "Kraków", "rejestr"),
    }


def test_parse_unit(spark):
    row = spark.createDataFrame([('{Polska,małopolskie,wadowicki,"Nowa Wieś"}',)], "v string").select(*places.parse_unit(F.col("v"))).first()
    assert tuple(row) == ("małopolskie", "wadowicki", "Nowa Wieś")


def test_normalize(spark):
    def raw(**given):
        have = {"source_key": "test", "external_id": "1", "url": "https://example.pl/oferta/1", "title": "Mieszkanie 2-pokojowe, ul. Leona Powolnego, Opole", "description": "Ładne mieszkanie 49 m2, 2 pokoje, 2 piętro z 3. Kontakt 537 123 123.", "kind": "nieruchomosc", "price": 629000.0} | given
        return tuple(have.get(f.name) for f in normalize.RAW.fields)

    rows = spark.createDataFrame([raw(), raw(external_id="2", title="Kupię mieszkanie"), raw(external_id="3", title="Polecane nieruchomości"), raw(external_id="4", title=None), raw(external_id="5", title="Mieszkanie do wynajęcia", price=2500.0)], normalize.RAW)
    found = {r.external_id: r for r in normalize.normalize(rows, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert set(found) == {"1", "5"}
    r = found["1"]
    assert (r.area, r.rooms, r.floor, r.floors_total, r.price_per_m2, r.property_type) == (49.0, 2, 2, 3, 12836.73, "mieszkanie")
    assert r.phones[0]["e164"] == "+48537123123" and r.phones[0]["masked"] == "537 *** ***"
    assert found["5"].transaction == "wynajem"


def test_alerts_are_told_once(spark):
    new = spark.createDataFrame([(i, float(i), dt.datetime(2026, 9, 1), True, "aktywna") for i in range(5)], "id long, price double, listed_at timestamp, is_original boolean, status string")
    found = alerts.matches(new, {1: Filters(price_max=2.0), 2: Filters(price_min=4.0)}, NOW)
    channels = spark.createDataFrame([(1, "mail"), (1, "web"), (2, "mail")], "search_id int, channel string")
    log = spark.createDataFrame([(1, 0, "mail")], "search_id int, id long, channel string")
    assert alerts.untold(found, channels, log).count() == 3 * 2 + 1 - 1
    assert alerts.matches(new, {}, NOW).count() == 0


def test_sitemap_chunks(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("id"))
    sizes = [r["count"] for r in stats.sitemap_chunks(rows, 300).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [300, 300, 300, 100]
    assert stats.sitemap_chunks(rows.limit(0), 300).count() == 0


def test_nearest(spark):
    a = spark.createDataFrame([(1, 50.0, 18.0), (2, None, None)], "id long, lat double, lon double")
    b = spark.createDataFrame([(10, 50.005, 18.0), (11, 50.001, 18.001), (12, 51.0, 18.0)], "id long, lat double, lon double")
    assert [(r.a_id, r.b_id) for r in places.nearest(a, b).collect()] == [(1, 11)]


def test_small_parts_of_search(spark):
    assert search.browsing({}).transaction == "sprzedaz" and search.browsing({"transaction": ""}).transaction is None and search.browsing({"transaction": "wynajem"}).transaction == "wynajem"
    rows = spark.createDataFrame(
        [(1, "garaz", "licytacja", dt.datetime(2026, 1, 5), None, [], 7, 0.7, "miasto", "Opole", 100.0), (2, "dom", "nieruchomosc", dt.datetime(2026, 1, 1), "600", [], None, None, None, "Nysa", None), (3, "dom", "nieruchomosc", dt.datetime(2026, 1, 2), None, ["5"], 8, None, None, None, None)],
        "id long, property_type string, kind string, first_seen timestamp, phone string, agency_phones array<string>, agency_id long, deal_ratio double, deal_level string, city string, opening_price double",
    )
    assert [r.id for r in search.detail_queue(rows, 2).collect()] == [3, 2]
    f = Filters(with_phone=True, only_original=False, only_active=False)
    assert {r.id for r in rows.where(search.predicate(f, rows, "2026-02-01 00:00:00")).collect()} == {2, 3}
    got = {r.id: r for r in search.records(rows).collect()}
    assert got[1].deal.below_percent == 30.0 and got[1].auction.opening_price == 100.0 and got[2].auction is None and got[2].deal is None and got[2].location.city == "Nysa" and got[3].seller.agency_id == 8
    phones_ = spark.createDataFrame([(1, "600 *"), (1, "500 *"), (9, "x")], "listing_id long, masked string")
    known = spark.createDataFrame([(7, "Biuro A", "Opole", "opolskie", 3, 5), (8, "Agencja B", None, None, 9, 1), (9, "Biuro C", "Opole", "opolskie", 0, 8)], "id long, name string, city string, voivodeship string, listings int, expected int")
    got = {r.id: (r.phones, r.agency_name) for r in search.with_contacts(rows, phones_, known).collect()}
    assert got == {1: (["500 *", "600 *"], "Biuro A"), 2: ([], None), 3: ([], "Agencja B")}
    assert [r.id for r in agencies.listed(known).collect()] == [8, 7, 9] and [r.id for r in agencies.listed(known, name="biuro", city="OPO", with_offers=True).collect()] == [7]
    seen = spark.createDataFrame([(1, "nieaktywna", dt.datetime(2020, 1, 1)), (2, "aktywna", dt.datetime(2020, 1, 1)), (3, "nieaktywna", dt.datetime(2026, 1, 1))], "id long, status string, last_seen timestamp")
    assert [r.status for r in upsert.archive(seen, F.lit("2026-02-01").cast("timestamp")).orderBy("id").collect()] == ["archiwalna", "aktywna", "nieaktywna"]
    points = spark.createDataFrame([(1, "Rynek", "city", 1.0, 1.0), (2, "Rynek", "portal", 1.0, 1.0), (3, None, "city", 1.0, 1.0)], "id long, street string, geo_precision string, lat double, lon double")
    cache = spark.createDataFrame([("a", "Rynek, Opole", "city"), ("b", "Opole", "city"), ("c", "Rynek 1, Opole", "address")], "query_hash string, query string, precision string")
    emptied, left = places.invalidate(points, cache)
    assert {r.id: r.lat for r in emptied.collect()} == {1: None, 2: 1.0, 3: 1.0} and {r.query_hash for r in left.collect()} == {"b", "c"}


def test_similar_offers_follow_their_rules(spark):
    """Nearest place first; an anchor without price or region finds something; a twin is left out only if price and area are known."""
    columns = "id long, kind string, property_type string, transaction string, status string, is_original boolean, price double, area double, rooms int, city string, county string, voivodeship string, lat double, lon double, district string"
    row = lambda i, price=500000.0, area=50.0, rooms=2, city="Opole", county="c", region="opolskie", kind="mieszkanie": (i, "nieruchomosc", kind, "sprzedaz", "aktywna", True, price, area, rooms, city, county, region, None, None, None)
    rows = [row(1), row(2, 520000.0, 52.0), row(3, 600000.0, 60.0, 3), row(4, 900000.0), row(5, area=90.0), row(6, 500500.0, 50.5), row(7, 510000.0, 51.0, city="Nysa"), row(8, kind="dom"), row(9, 505000.0, 51.0, city="X", county="d"), row(10, price=None, area=51.0)]
    df = spark.createDataFrame(rows, columns)
    got = [(r.id, r.level) for r in similar.similar(df, df.where("id = 1"), lambda d: d.checkpoint()).orderBy("place").collect()]
    assert got == [(2, 0), (3, 0), (7, 1), (9, 2)]
    no_price = spark.createDataFrame([row(20, price=None, area=None, rooms=None, region=None)], columns)
    assert {r.id for r in similar.similar(df, no_price, lambda d: d.checkpoint()).collect()} >= {1, 2, 7}


def test_latest_of_a_batch_with_maps(spark):
    rows = [("a", "1", {"x": "1", "y": "2"}), ("a", "1", {"y": "2", "x": "1"}), ("a", "1", None), ("a", "2", {})]
    batch = spark.createDataFrame(rows, "source_key string, external_id string, extra map<string,string>").selectExpr("*", "struct(extra) AS deep")
    first = {r.external_id: r.extra for r in upsert.latest_per_key(batch).collect()}
    again = {r.external_id: r.extra for r in upsert.latest_per_key(batch.orderBy(F.desc_nulls_last("external_id")).repartition(3)).collect()}
    assert first == again and first["2"] == {}
