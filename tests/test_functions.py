"""Scalar functions on the cases that define them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kadastra.functions import dates, fuzzy, geo, numbers, phones, text


def one(spark, expression, value=None):
    rows = spark.createDataFrame([(value,)], "v string")
    return rows.select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, number",
    [("629 000 zł", 629000.0), ("629.000", 629000.0), ("75,28 m²", 75.28), ("12 837 zł/m²", 12837.0), ("0,0436", 0.0436), ("0,5981 ha", 0.5981), ("1,250,000", 1250000.0), ("cena do negocjacji", None), (None, None), ("", None), ("1.234.567,89", 1234567.89)],
)
def test_parse_number(spark, raw, number):
    assert one(spark, numbers.parse_number, raw) == number


@pytest.mark.parametrize("raw, size", [("Mieszkanie 3 pokoje, 49 m2", 49.0), ("Dom, 1 240 m2", 1240.0), ("bez metrażu", None)])
def test_area(spark, raw, size):
    assert one(spark, numbers.area, raw) == size


@pytest.mark.parametrize("raw, size", [("działka 12 arów", 1200.0), ("grunt o pow. 0,45 ha", 4500.0), ("działka nr 12", None)])
def test_plot_area(spark, raw, size):
    assert one(spark, numbers.plot_area, raw) == size


def test_parameters(spark):
    assert one(spark, numbers.rooms, "Przestronne 4-pokojowe mieszkanie") == 4
    assert one(spark, lambda v: F.struct(*numbers.floor(v)), "2 piętro z 3")[:] == (2, 3)
    assert one(spark, lambda v: numbers.floor(v)[0], "lokal na parterze") == 0
    assert one(spark, numbers.case_number, "sygn. akt Km 1234/23") == "Km 1234/23"
    assert one(spark, numbers.year, "rok budowy: 1987") == 1987


@pytest.mark.parametrize("price, fine", [(None, True), ("0", False), ("-5", False), ("11111111", False), ("1234567890", False), ("1000000", True), ("400000000", False)])
def test_plausible_price(spark, price, fine):
    assert one(spark, lambda v: numbers.plausible_price(v.cast("double")), price) is fine


def test_price_per_m2(spark):
    rate = lambda p, a: one(spark, lambda v: numbers.price_per_m2(F.lit(p), F.lit(a)))
    assert rate(629000.0, 49.0) == 12836.73
    assert rate(1.0, 3.0) == 0.3333
    assert rate(1.0, 0.0) is None


def test_html(spark):
    assert one(spark, text.strip_html, "<p>Ładne <b>mieszkanie</b></p><br>49 m2") == "Ładne mieszkanie 49 m2"
    assert one(spark, text.strip_html, "Dom&nbsp;z ogrodem &amp; garażem") == "Dom z ogrodem & garażem"
    assert one(spark, text.unescape, "SPA&amp;amp;GYM") == "SPA&GYM"
    assert one(spark, text.strip_html, None) == ""


def test_keys(spark):
    assert one(spark, text.slug, "Biuro Nieruchomości Śródmieście") == "biuro-nieruchomosci-srodmiescie"
    assert one(spark, text.slug, None) == "brak"
    assert one(spark, text.norm_key, " Łódź,  ul. Żółta ") == "lodz ul zolta"
    assert one(spark, text.fold, "ŁÓDŹ Święta") == "lodz swieta"


def test_shingle_hash(spark):
    words = " ".join(f"słowo{i}" for i in range(20))
    assert one(spark, text.shingle_hash, words) == one(spark, text.shingle_hash, words.upper())
    assert one(spark, text.shingle_hash, "dwa słowa") is None
    assert one(spark, text.shingle_hash, None) is None


@pytest.mark.parametrize("street, terms", [("ul. Browarna 12/4", ["browarn"]), ("al. Wojska Polskiego", ["wojsk", "polskiego"]), ("", []), ("Rynek", ["rynek"])])
def test_street_terms(spark, street, terms):
    assert one(spark, text.street_terms, street) == terms


@pytest.mark.parametrize("street, label", [("Al. Aleja Jana Pawła II", "Jana Pawła II"), ("ul. OZIMSKIEJ 3", "Ozimska"), ("okolice ul. Emila Zoli", "Emila Zoli")])
def test_street_label(spark, street, label):
    assert one(spark, text.street_label, street) == label


@pytest.mark.parametrize(
    "title, kind",
    [("Kawalerka w centrum", "mieszkanie"), ("Dom wolnostojący", "dom"), ("Działka budowlana", "dzialka"), ("Hala magazynowa", "hala"), ("Garaż murowany", "garaz"), ("Coś", "inne")],
)
def test_property_type(spark, title, kind):
    assert one(spark, text.property_type, title) == kind


def test_seller_type(spark):
    who = lambda told, kind, name, body="": one(spark, lambda v: text.seller_type(F.lit(told), F.lit(kind), F.lit(name), F.lit(None).cast("string"), F.lit(""), F.lit(body)))
    assert who("syndyk", "nieruchomosc", "X") == "syndyk"
    assert who("nieznany", "licytacja", None) == "komornik"
    assert who("nieznany", "nieruchomosc", "Urząd Miasta Opole") == "urzad"
    assert who("nieznany", "nieruchomosc", "ABC Development") == "deweloper"
    assert who("nieznany", "nieruchomosc", "Dobre Nieruchomości") == "posrednik"
    assert who("nieznany", "nieruchomosc", "Jan", "bez pośredników") == "prywatna"
    assert who(None, "nieruchomosc", "Jan") == "nieznany"


@pytest.mark.parametrize(
    "raw, moment",
    [
        ("12 marca 2025", dt.datetime(2025, 3, 12)), ("05.03.2026", dt.datetime(2026, 3, 5)), ("5 marca 2026", dt.datetime(2026, 3, 5)), ("05-03-2026", dt.datetime(2026, 3, 5)),
        ("2026-09-12", dt.datetime(2026, 9, 12)), ("2026-09-12T10:41:34+02:00", dt.datetime(2026, 9, 12, 8, 41, 34)), ("2026-09-05 10:41:34", dt.datetime(2026, 9, 5, 10, 41, 34)),
        ("wczoraj", dt.datetime(2026, 9, 29)), ("dzisiaj 12:00", dt.datetime(2026, 9, 30)), ("nie wiadomo", None), (None, None),
    ],
)
def test_parse_moment(spark, raw, moment):
    assert one(spark, lambda v: dates.parse_moment(v, F.lit("2026-09-30 18:00:00").cast("timestamp")), raw) == moment


def test_unix_moments(spark):
    for raw in ("1757672494", "1757672494000"):
        assert one(spark, lambda v: dates.parse_moment(v, F.lit("2026-01-01").cast("timestamp")), raw).date() == dt.date(2025, 9, 12)


def test_warsaw(spark):
    local = one(spark, lambda v: dates.parse_moment(v, F.lit("2026-09-30").cast("timestamp"), True), "2026-09-21 19:13:17")
    assert local == dt.datetime(2026, 9, 21, 17, 13, 17)
    midnight = lambda t: one(spark, lambda v: dates.warsaw_midnight_utc(v.cast("timestamp")), t)
    assert midnight("2026-09-21 17:00:00") == dt.datetime(2026, 9, 20, 22)
    assert midnight("2026-09-21 23:30:00") == dt.datetime(2026, 9, 21, 22)
    assert midnight("2026-12-05 12:00:00") == dt.datetime(2026, 12, 4, 23)


def test_distance(spark):
    km = one(spark, lambda v: geo.haversine_km(F.lit(50.6751), F.lit(17.9213), F.lit(51.1079), F.lit(17.0385)))
    assert 75 < km < 90


def test_phones(spark):
    found = lambda t, **k: [p["e164"] for p in one(spark, lambda v: phones.phones(v, **k), t)]
    assert found("tel. 604-123-456") == ["+48604123456"]
    assert found("dzwoń 77 123 45 67") == ["+48771234567"]
    assert found("numer działki 111/22, powierzchnia 1200") == []
    assert found(None) == []
    assert found("call +1 (743) 555-3824", region="US") == ["+17435553824"]
    assert phones.mask("537123123") == "537 *** ***"


def test_token_set_ratio():
    assert fuzzy.token_set_ratio("biuro opole", "opole biuro") == 100
    assert fuzzy.token_set_ratio("", "x") == 0
    assert fuzzy.token_set_ratio("dom w opolu", "hala w krakowie") < 60
    assert fuzzy.indel_ratio("abcd", "abxd") == 75


def test_references_labels_and_spelt_numbers(spark):
    texts = ["SPA&amp;amp;GYM", "Dom &oacute;w &#8211; x", "a & b", None, "R&amp;D &nbsp;x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.o for r in df.orderBy("i").select(text.unescape(F.col("t")).alias("o")).collect()] == ["SPA&GYM", "Dom ów – x", "a & b", "", "R&D \u00a0x"]
    got = spark.createDataFrame([("Portal Ogłoszeń — nieruchomości", "k"), (None, "bip_opole")], "n string, k string").select(text.source_label(F.col("n"), F.col("k")).alias("s"), text.short_label(F.lit("x" * 39 + ", yz")).alias("l")).collect()
    assert [r.s for r in got] == ["Portal Ogłoszeń", "bip opole"] and got[0].l == "x" * 39 + "…"
    told = spark.createDataFrame([("tel. sześć zero cztery 123 456",), ("sześć zero cztery jeden dwa trzy cztery pięć sześć",), ("jeden dwa trzy",)], "t string").select(phones.phones(F.col("t")).alias("p")).collect()
    assert [x.e164 for x in told[1].p] == ["+48604123456"] and told[1].p[0].origin == "opis" and told[2].p == []


def test_sql_phones_take_their_key(spark):
    from kadastra.functions import phones, sql

    sql.register(spark)
    rows = spark.sql("select inline(extract_phones('tel. 600 100 200', k)) from values ('a'), ('b') as t(k)").collect()
    assert {r.hashed for r in rows} == {phones.hashed("+48600100200", k) for k in (b"a", b"b")}
