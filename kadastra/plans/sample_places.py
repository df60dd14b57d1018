"""A small registry of units, and texts with the places that they name: inputs of the registered queries and of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "teryt string, name string, kind string, voivodeship string, county string, commune string, town boolean, city_county boolean, district_unit boolean"

#: Cities with county rights: code, name, region.
CITIES = [
    ("126101", "Kraków", "małopolskie"), ("166101", "Opole", "opolskie"), ("026401", "Wrocław", "dolnośląskie"), ("106101", "Łódź", "łódzkie"), ("306401", "Poznań", "wielkopolskie"),
    ("246101", "Bielsko-Biała", "śląskie"), ("086201", "Zielona Góra", "lubuskie"), ("186301", "Rzeszów", "podkarpackie"), ("326201", "Szczecin", "zachodniopomorskie"), ("046301", "Toruń", "kujawsko-pomorskie"),
    ("066101", "Biała Podlaska", "lubelskie"), ("046201", "Grudziądz", "kujawsko-pomorskie"), ("026101", "Jelenia Góra", "dolnośląskie"), ("086101", "Gorzów Wielkopolski", "lubuskie"), ("126201", "Nowy Sącz", "małopolskie"),
    ("286101", "Elbląg", "warmińsko-mazurskie"), ("246401", "Częstochowa", "śląskie"), ("226401", "Sopot", "pomorskie"), ("226101", "Gdańsk", "pomorskie"), ("306301", "Leszno", "wielkopolskie"),
]
#: Communes: code, name, region, county, whether the seat is a town.
COMMUNES = [
    ("160705", "Nysa", "opolskie", "nyski", True), ("161105", "Strzelce Opolskie", "opolskie", "strzelecki", True), ("160301", "Kędzierzyn-Koźle", "opolskie", "kędzierzyńsko-kozielski", True),
    ("221301", "Starogard Gdański", "pomorskie", "starogardzki", True), ("160401", "Kluczbork", "opolskie", "kluczborski", True), ("160606", "Świerczów", "opolskie", "namysłowski", False),
    ("142405", "Świercze", "mazowieckie", "pułtuski", False), ("160604", "Pokój", "opolskie", "namysłowski", False), ("321702", "Dobra", "zachodniopomorskie", "łobeski", True), ("221404", "Nowe", "kujawsko-pomorskie", "świecki", True),
    ("160602", "Miejsce", "opolskie", "namysłowski", False), ("160902", "Dąbrowa", "opolskie", "opolski", False), ("121301", "Osiek", "małopolskie", "oświęcimski", False), ("221303", "Osiek", "pomorskie", "starogardzki", False),
]
#: Counties: code, name, region.
COUNTIES = [("1606", "namysłowski", "opolskie"), ("2213", "starogardzki", "pomorskie"), ("1607", "nyski", "opolskie")]
UNITS = (
    [(t, n, "miasto", r, n, n, True, True, False) for t, n, r in CITIES]
    + [(t, n, "gmina", r, c, n, town, False, False) for t, n, r, c, town in COMMUNES]
    + [(t, n, "powiat", r, n, None, False, False, False) for t, n, r in COUNTIES]
    + [("126105", "Podgórze", "gmina", "małopolskie", "Kraków", "Kraków", True, False, True), ("16", "opolskie", "wojewodztwo", "opolskie", None, None, False, False, False)]
)

#: Texts, and the code of the place that each names (none: nothing).
TEXTS = [
    ("Ładne mieszkanie w Krakowie", "126101"), ("Kawalerka w Opolu, wolna", "166101"), ("Trzy pokoje w Nysie", "160705"), ("Loft w Łodzi blisko centrum", "106101"), ("Dom w Strzelcach Opolskich", "161105"),
    ("Garaż w Kędzierzynie-Koźlu", "160301"), ("Magazyn w Poznaniu", "306401"), ("Grunt we Wrocławiu", "026401"), ("Lokal w Bielsku-Białej", "246101"), ("Biuro w Zielonej Górze", "086201"),
    ("Sklep w Rzeszowie", "186301"), ("Pokój w Szczecinie", "326201"), ("Segment w Toruniu", "046301"), ("Działka w Białej Podlaskiej", "066101"), ("Mieszkanie w Starogardzie Gdańskim", "221301"),
    ("Kamienica w Grudziądzu", "046201"), ("Willa w Jeleniej Górze", "026101"), ("Dom w Gorzowie Wielkopolskim", "086101"), ("Bliźniak w Nowym Sączu", "126201"), ("Szeregowiec w Elblągu", "286101"),
    ("Mieszkanie w Częstochowie", "246401"), ("Apartament w Sopocie", "226401"), ("Miejsce postojowe pod ziemią w Krakowie", "126101"), ("Leszno ul. Towarowa działki", "306301"), ("Mieszkanie 3 pokoje, 62 m2, Kluczbork", "160401"),
    ("Dobra oferta, tanio, pilnie", None), ("Nowe mieszkanie z balkonem", None), ("Miejsce postojowe podziemne", None), ("mieszkanie z piwnicą, do wprowadzenia", None), ("Działka w gminie Pokój", "160604"),
    ("Dom w miejscowości Dobra, gm. Dobra", "321702"), ("Mieszkanie w Starogardzie Gdańskim: Starogard Gdański: Gdańska", "221301"), ("Dom w Sopocie przy ul. Gdańskiej", "226401"), ("Działka, gm. Świerczów, pow. namysłowski", "160606"),
    ("Działka pod lasem, Dąbrowa, woj. opolskie", "160902"), ("Oferty: dolnośląskie lubelskie opolskie Dąbrowa", None), ("Podgórze, widok na rzekę", None), ("Grunt położony w Osiek, woj. pomorskie", "221303"),
]


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, SCHEMA)
