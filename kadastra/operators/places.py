"""Places: a registry of units as an input table, lookups by name and code, reverse lookups. Names in text: ``locate.py``.

``units`` has teryt, name, kind, voivodeship, county, commune, town, city_county, district_unit; ``boxes`` has
voivodeship, lat_min, lat_max, lon_min, lon_max. Both are reference tables of fixed size (tens of thousands of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import geo, text

#: Units that are broadcast at most (under 200 bytes each); a larger registry is joined by a shuffle.
BROADCAST_UNITS = 200_000
#: Boxes of regions that an expression is made of; more are refused.
MAX_BOXES = 256


def rank() -> Column:
    """How much a unit's name means on its own."""
    return F.when(F.col("city_county"), 100).when(F.col("town"), 70).when(F.col("kind") == "powiat", 60).otherwise(30)


def by_code(rows: DataFrame, units: DataFrame, code: str = "teryt") -> DataFrame:
    """The most exact unit whose code a longer code begins with (7, 6, 4 or 2 digits)."""
    found = units.select(F.col("teryt").alias("u"), F.col("name").alias("unit_name"), F.col("voivodeship").alias("unit_voivodeship"))
    asked = rows.select(code).distinct().select(code, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.substring(code, 1, n).alias("u")) for n in (7, 6, 4, 2)))).alias("p")).select(code, "p.*")
    best = asked.join(found, "u").groupBy(code).agg(F.max_by(F.struct("unit_name", "unit_voivodeship"), "n").alias("best"))
    return rows.join(best, code, "left").select(*rows.columns, "best.*")


def small(units: DataFrame) -> DataFrame:
    """The registry, broadcast if it is as small as registries are."""
    return F.broadcast(units) if units.count() <= BROADCAST_UNITS else units


def name_key(name: Column) -> Column:
    """What a place is looked up by: its name up to a comma, slash or bracket, folded."""
    return F.nullif(F.trim(text.fold(F.regexp_extract(name, r"^[^,/(]*", 0))), F.lit(""))


def known(units: DataFrame) -> DataFrame:
    """Units that a name may mean: no regions, no parts of towns."""
    rows = units.where((F.col("kind") != "wojewodztwo") & ~F.coalesce("district_unit", F.lit(False))) if "district_unit" in units.columns else units.where(F.col("kind") != "wojewodztwo")
    commune = F.col("commune") if "commune" in units.columns else F.lit(None).cast("string")
    return rows.select(name_key(F.col("name")).alias("unit_key"), "teryt", F.col("name").alias("unit_name"), F.col("kind").alias("unit_kind"), F.col("voivodeship").alias("unit_region"), F.col("county").alias("unit_county"), commune.alias("unit_commune"), rank().alias("unit_rank"))


def resolve(rows: DataFrame, units: DataFrame, name: str = "place", region: str = "hint") -> DataFrame:
    """Name and region hint to a unit: teryt, unit_name, unit_commune, unit_county and unit_region.

    Of units with the name those in the hinted region come first, then the one of highest rank. Of several without a hint
    and none of town rank only the name is known. Each name and hint is looked up once.
    """
    asked = rows.select(F.col(name).alias("__n"), F.col(region).alias("__h")).where("__n is not null").distinct()
    joined = asked.join(small(known(units)), name_key(F.col("__n")) == F.col("unit_key"))
    inside = F.coalesce(F.col("__h") == F.col("unit_region"), F.lit(False))
    best = F.min(F.struct((~inside).alias("outside"), (-F.col("unit_rank")).alias("minor"), (F.col("unit_kind") != "gmina").alias("other"), "unit_name", "teryt", "unit_commune", "unit_county", "unit_region")).alias("b")
    found = joined.groupBy("__n", "__h").agg(best, F.count("*").alias("n"))
    sure = (F.col("n") == 1) | F.col("__h").isNotNull() | (F.col("b.minor") <= -C.TOWN_RANK)
    found = found.select("__n", "__h", F.col("b.unit_name").alias("unit_name"), *(F.when(sure, F.col(f"b.{c}")).alias(c) for c in ("teryt", "unit_commune", "unit_county", "unit_region")))
    return rows.join(found, (rows[name] == F.col("__n")) & rows[region].eqNullSafe(F.col("__h")), "left").drop("__n", "__h")


def region_of_point(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """The region whose box holds a point, of several the smallest; ``boxes`` has one row per region."""
    b = boxes.select(F.col("voivodeship").alias("box_region"), "lat_min", "lat_max", "lon_min", "lon_max").withColumn("size", (F.col("lat_max") - F.col("lat_min")) * (F.col("lon_max") - F.col("lon_min")))
    rows = b.limit(MAX_BOXES + 1).collect()
    if len(rows) > MAX_BOXES:
        raise ValueError(f"over {MAX_BOXES} boxes")
    held = [F.when(geo.in_box(F.col("lat"), F.col("lon"), r["lat_min"], r["lat_max"], r["lon_min"], r["lon_max"]), r["box_region"]) for r in sorted(rows, key=lambda r: (r["size"], r["box_region"]))]
    return df.withColumn("box_region", F.coalesce(*held) if held else F.lit(None).cast("string"))


def neighbours(left: DataFrame, right: DataFrame, km: float, cell: float = 0.05) -> DataFrame:
    """Pairs of points at most ``km`` apart: cells of ``cell`` degrees meet with their neighbours in an equi-join."""
    reach_lat, reach_lon = max(1, int(km / 111.0 / cell) + 1), max(1, int(km / 60.0 / cell) + 1)
    grid = lambda c: F.floor(F.col(c) / cell).cast("long")
    around = F.explode(F.flatten(F.array(*(F.array(*(F.struct((grid("lat") + i).alias("x"), (grid("lon") + j).alias("y")) for j in range(-reach_lon, reach_lon + 1))) for i in range(-reach_lat, reach_lat + 1)))))
    a = left.where("lat is not null and lon is not null").select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), around.alias("c")).select("*", "c.x", "c.y").drop("c")
    b = right.where("lat is not null and lon is not null").select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), grid("lat").alias("x"), grid("lon").alias("y"))
    d = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return a.join(b, ["x", "y"]).where(F.col("a_id") != F.col("b_id")).withColumn("km", d).where(F.col("km") <= km).select("a_id", "b_id", "km")


def nearest(left: DataFrame, right: DataFrame, km: float = C.REVERSE_RADIUS_KM) -> DataFrame:
    """The nearest point within reach (reverse geocoding against a local table)."""
    return neighbours(left, right, km).groupBy("a_id").agg(F.min(F.struct("km", "b_id")).alias("best")).select("a_id", "best.*")


def surroundings(df: DataFrame, points: DataFrame, km: float, most: int = 120) -> DataFrame:
    """What lies near each listing: the least distance by label, nearest first; ``points`` has id, lat, lon, label."""
    found = neighbours(df, points, km)
    w = Window.partitionBy("a_id").orderBy("km", "b_id")
    near = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return near.join(points.select(F.col("id").alias("b_id"), "label"), "b_id").groupBy("a_id", "label").agg(F.min("km").alias("km"))


def geocode(df: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings without a point filled from cached addresses, one lookup per address; and the addresses not in the cache."""
    key = text.digest(text.norm_key(F.concat_ws(", ", "street", "city", "voivodeship")))
    c = cache.select("query_hash", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    joined = df.withColumn("query_hash", key).join(c, "query_hash", "left")
    filled = joined.select(*((F.coalesce(x, f"c_{x}").alias(x) if x in ("lat", "lon") else F.col(x)) for x in df.columns))
    asked = df.where("lat is null or lon is null").withColumn("query_hash", key).groupBy("query_hash").agg(F.min("street").alias("street"), F.min("city").alias("city"), F.count("*").alias("listings"))
    return filled, asked.join(cache.select("query_hash"), "query_hash", "left_anti")


def invalidate(df: DataFrame, cache: DataFrame, imprecise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Listings and cache to be geocoded anew: with ``imprecise``, listings with a street whose point is only that of a town or
    district, and such cache rows of asked addresses with a comma; otherwise all."""
    rough = F.coalesce(F.col("geo_precision").isin("city", "district"), F.lit(False)) if imprecise else F.lit(True)
    go = (F.col("street").isNotNull() & rough) if imprecise else F.col("lat").isNotNull()
    emptied = df.select(*((F.when(~go, F.col(c)).alias(c) if c in ("lat", "lon", "geo_precision") else F.col(c)) for c in df.columns))
    stale = F.coalesce(F.col("precision").isin("city", "district") & F.col("query").contains(","), F.lit(False)) if imprecise else F.lit(True)
    return emptied, cache.where(~stale)


def parse_unit(value: Column) -> tuple[Column, Column, Column]:
    """Region, county and commune of a text like {Polska,małopolskie,wadowicki,Spytkowice}; names may be quoted."""
    parts = F.transform(F.regexp_extract_all(value, F.lit(r'("[^"]*"|[^{},]+)'), 1), lambda p: F.trim(F.translate(p, '"', "")))
    return F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
