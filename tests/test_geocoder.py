"""The geocoder's levels, and nearest points against all pairs."""

import math
import random

import pytest

from kadastra.operators import geocoder

REGISTER = "id long, city string, voivodeship string, district string, street string, number string, lat double, lon double"
ROWS = [
    (1, "Opole", "opolskie", "Zaodrze", "ul. Polna", "1", 50.60, 17.90), (2, "Opole", "opolskie", "Zaodrze", "Polna", "3A", 50.62, 17.92), (3, "Opole", "opolskie", None, "Rynek", "5", 50.70, 17.80),
    (4, "Brzeg", "opolskie", None, None, None, 50.86, 17.47), (5, "Brzeg", "pomorskie", None, None, None, 54.0, 18.0), (6, "Opole", "opolskie", "Daleka", None, None, 50.64, 18.6),
]
LISTING = "id long, city string, voivodeship string, district string, street string, lat double, lon double, geo_precision string"


def listing(i, city, region=None, district=None, street=None, lat=None, lon=None, precision=None):
    return (i, city, region, district, street, lat, lon, precision)


def test_levels_one_after_the_other(spark):
    rows = [
        listing(1, "Opole", "opolskie", None, "ul. Polna 3a"), listing(2, "opole", "Opolskie", "Zaodrze", "Polna 77"), listing(3, "Opole", None, "Zaodrze"), listing(4, "Opole", "opolskie", "Zaodrze", "Nieznana 1"), listing(5, "Brzeg", "opolskie"), listing(6, "Brzeg"), listing(7, None, "opolskie"),
        listing(8, "Opole", "opolskie", None, None, 1.0, 2.0, "portal"), listing(9, "Opole", "opolskie", "Daleka"), listing(10, "Brzeg", "pomorskie"), listing(1, "Opole", "opolskie", None, "ul. Polna 3a"),
    ]
    boxes = spark.createDataFrame([("opolskie", 49.9, 51.2, 16.9, 18.7), ("pomorskie", 10.0, 11.0, 10.0, 11.0)], "voivodeship string, lat_min double, lat_max double, lon_min double, lon_max double")
    register = spark.createDataFrame(ROWS, REGISTER)
    got = geocoder.cascade(spark.createDataFrame(rows, LISTING), register, boxes).collect()
    assert len(got) == len(rows)
    got = {r.id: (r.geo_precision, r.lat and round(r.lat, 4), r.lon and round(r.lon, 4)) for r in got}
    mean = (round((50.60 + 50.62 + 50.70 + 50.64) / 4, 4), round((17.90 + 17.92 + 17.80 + 18.6) / 4, 4))
    assert got == {1: ("address", 50.62, 17.92), 2: ("street", 50.61, 17.91), 3: ("district", 50.61, 17.91), 4: ("city", *mean), 5: ("city", 50.86, 17.47), 6: (None, None, None), 7: (None, None, None), 8: ("portal", 1.0, 2.0), 9: ("city", *mean), 10: (None, None, None)}


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("reach", [1.5, 30.0])
def test_nearest_equals_all_pairs(spark, reach):
    r = random.Random(3)
    point = lambda spread: (50 + r.random() * spread, 18 + r.random() * spread)
    a = {i: point(r.choice([0.02, 1.0, 4.0])) for i in range(150)}
    b = {1000 + i: point(r.choice([0.02, 1.0, 4.0])) for i in range(120)} | {2000: a[3], 2001: a[3]}
    want = {}
    for i, p in a.items():
        d, j = min((km(p, q), j) for j, q in b.items())
        if d <= reach:
            want[i] = (round(d, 6), j)
    frame = lambda points: spark.createDataFrame([(i, *p) for i, p in points.items()] + [(9999, None, None)], "id long, lat double, lon double")
    got = geocoder.nearest(frame(a), frame(b), reach, lambda d: d.checkpoint()).collect()
    assert {x.a_id: (round(x.km, 6), x.b_id) for x in got} == want and len(got) == len(want) > 20


def test_names_of_points(spark):
    df = spark.createDataFrame([listing(1, None, None, None, None, 50.601, 17.901), listing(2, "Nysa", None, None, None, 50.601, 17.901), listing(3, None, None, None, "Boczna", 50.7, 17.8), listing(4, None, None, None, None, 40.0, 10.0)], LISTING)
    got = {r.id: (r.city, r.street) for r in geocoder.names(df, spark.createDataFrame(ROWS, REGISTER), lambda d: d.checkpoint()).collect()}
    assert got == {1: ("Opole", "ul. Polna"), 2: ("Nysa", None), 3: ("Opole", "Boczna"), 4: (None, None)}
