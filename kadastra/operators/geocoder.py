"""Points for addresses from a local register, level by level, and names for points by rings that grow until something is near."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import geo, text

#: From the most to the least precise.
LEVELS = ("address", "street", "district", "city")
#: How far a district may lie from its town's point.
DISTRICT_KM = 15.0
#: Side of the smallest cells of the rings, in degrees, and kilometres of a degree of latitude (a little less than there are).
CELL, DEGREE_KM = 0.01, 111.0


def _town(city: Column, region: Column) -> Column:
    return F.concat_ws("|", F.nullif(text.norm_key(city), F.lit("")), F.coalesce(text.fold(region), F.lit("")))


def _street(street: Column) -> tuple[Column, Column]:
    name, number = text.house_number(street)
    return F.nullif(text.norm_key(text.strip_street_prefix(name)), F.lit("")), F.nullif(F.lower(F.trim(number)), F.lit(""))


def levels(register: DataFrame) -> DataFrame:
    """A register of addresses (city, voivodeship, district, street, number, lat, lon) as points to look up: level, key, lat, lon.

    The number may stand in its own column or behind the street's name. A street's, district's and town's point is the mean of its addresses. Towns are known with their region, and by name
    alone where only one region has a town of that name."""
    r = register.where("city is not null and lat is not null and lon is not null")
    street, told = _street(F.col("street"))
    r = r.select("city", "voivodeship", text.norm_key(F.col("city")).alias("town"), F.nullif(text.norm_key(F.col("district")), F.lit("")).alias("part"), street.alias("road"), F.coalesce(F.nullif(F.lower(F.trim("number")), F.lit("")), told).alias("house"), "lat", "lon")
    regions = r.groupBy("town").agg((F.countDistinct("voivodeship") <= 1).alias("alone"))
    r = r.join(regions, "town").withColumn("at", F.explode(F.when(F.col("alone"), F.array(_town(F.col("city"), F.col("voivodeship")), _town(F.col("city"), F.lit(None)))).otherwise(F.array(_town(F.col("city"), F.col("voivodeship"))))))
    key = lambda level, *parts: F.struct(F.lit(level).alias("level"), F.when(F.concat(*parts).isNotNull(), F.concat_ws("|", *parts)).alias("key"))
    keys = F.array(key("address", F.col("at"), F.col("road"), F.col("house")), key("street", F.col("at"), F.col("road")), key("district", F.col("at"), F.col("part")), key("city", F.col("at")))
    told = r.select(F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k"), "lat", "lon").select("k.level", "k.key", "lat", "lon")
    return told.groupBy("level", "key").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def cascade(df: DataFrame, register: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Listings without a point filled from the register: by address, else street, else district, else town, with ``geo_precision``.

    A district counts only for a listing without a street, and within DISTRICT_KM of its town. A point outside the listing's
    region (``boxes``: voivodeship, lat_min, lat_max, lon_min, lon_max) is none, and the next level is tried. Each
    different address is looked up once; what nothing is found for stays without a point."""
    road, house = _street(F.col("street"))
    named = df.withColumns({"__town": _town(F.col("city"), F.col("voivodeship")), "__road": road, "__house": house, "__part": F.nullif(text.norm_key(F.col("district")), F.lit("")) if "district" in df.columns else F.lit(None).cast("string")})
    columns = ["__town", "__road", "__house", "__part"]
    asked = named.where("lat is null or lon is null").where(F.col("city").isNotNull()).select(*columns, F.col("voivodeship").alias("__region")).distinct()
    parts = {"address": ["__road", "__house"], "street": ["__road"], "district": ["__part"], "city": []}
    wanted = F.array(*(F.struct(F.lit(level).alias("level"), F.when(F.concat("__town", *parts[level]).isNotNull(), F.concat_ws("|", "__town", *parts[level])).alias("key")) for level in LEVELS))
    known = levels(register)
    found = asked.withColumn("w", F.explode(F.filter(wanted, lambda w: w["key"].isNotNull()))).select(*columns, "__region", "w.level", "w.key").join(known, ["level", "key"])
    if boxes is not None:
        b = boxes.select(F.col("voivodeship").alias("__region"), "lat_min", "lat_max", "lon_min", "lon_max")
        found = found.join(b, "__region", "left").where(F.col("lat_min").isNull() | geo.in_box(F.col("lat"), F.col("lon"), F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max")))
    at = lambda level: F.max(F.when(F.col("level") == level, F.struct("lat", "lon")))
    points = found.groupBy(*(F.coalesce(c, F.lit("")).alias(f"g_{c}") for c in columns)).agg(*(at(level).alias(level) for level in LEVELS))
    far = F.col("city").isNotNull() & (geo.haversine_km(F.col("district.lat"), F.col("district.lon"), F.col("city.lat"), F.col("city.lon")) > DISTRICT_KM)
    district = F.when((F.col("g___road") == "") & ~far, F.col("district"))
    best = F.coalesce(*(F.when(p.isNotNull(), F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.lit(level).alias("level"))) for level, p in zip(LEVELS, (F.col("address"), F.col("street"), district, F.col("city")), strict=True)))
    points = points.select(*(f"g_{c}" for c in columns), best.alias("p"))
    joined = named.join(points, [F.coalesce(c, F.lit("")) == F.col(f"g_{c}") for c in columns], "left")
    take = (F.col("lat").isNull() | F.col("lon").isNull()) & F.col("city").isNotNull() & F.col("p").isNotNull()
    out = {"lat": F.when(take, F.col("p.lat")).otherwise(F.col("lat")), "lon": F.when(take, F.col("p.lon")).otherwise(F.col("lon"))}
    precision = F.when(take, F.col("p.level")).otherwise(F.col("geo_precision") if "geo_precision" in df.columns else F.lit(None).cast("string"))
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns if c != "geo_precision"), precision.alias("geo_precision"))


def nearest(left: DataFrame, right: DataFrame, km: float, save: Callable[[DataFrame], DataFrame], cell: float = CELL, one_table: bool = False) -> DataFrame:
    """For each point of ``left`` (id, lat, lon) the nearest one of ``right`` within ``km``: a_id, km, b_id; of equally near ones the smaller id. With
    ``one_table`` a row is no neighbour of itself.

    Points meet in cells, with the eight around them. What is found nearer than a cell's side is the nearest there is; all
    other points ask again in cells twice as large, up to cells of ``km``. So a point in a dense place meets its few neighbours
    and never all that lie within reach."""
    a = left.where("lat is not null and lon is not null").select(F.col("id").alias("a_id"), F.col("lat").cast("double").alias("a_lat"), F.col("lon").cast("double").alias("a_lon"))
    b = right.where("lat is not null and lon is not null").select(F.col("id").alias("b_id"), F.col("lat").cast("double").alias("b_lat"), F.col("lon").cast("double").alias("b_lon"))
    out, side = None, cell
    while True:
        narrow = F.lit(side * DEGREE_KM) * F.cos(F.radians(F.least(F.abs("a_lat") + 2 * side, F.lit(89.0))))  # a cell's side from east to west
        last = side * DEGREE_KM * math.cos(math.radians(70)) >= km
        grid = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")  # noqa: E731, B023
        around = F.explode(F.array(*(F.struct((grid("a_lat") + i).alias("x"), (grid("a_lon") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        pairs = a.select("a_id", "a_lat", "a_lon", around.alias("c")).select("*", "c.x", "c.y").drop("c").join(b.select("*", grid("b_lat").alias("x"), grid("b_lon").alias("y")), ["x", "y"])
        measured = (pairs.where(F.col("a_id") != F.col("b_id")) if one_table else pairs).withColumn("km", geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
        best = measured.groupBy("a_id").agg(F.min(F.struct("km", "b_id")).alias("best"), F.first(narrow).alias("sure")).select("a_id", "best.*", "sure")
        best = save(best.where(F.col("km") <= km) if last else best.where(F.col("km") <= F.least("sure", F.lit(km))))
        done = best.select("a_id", "km", "b_id")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        a, side = save(a.join(best.select("a_id"), "a_id", "left_anti")), side * 2


def names(df: DataFrame, register: DataFrame, save: Callable[[DataFrame], DataFrame], km: float = C.REVERSE_RADIUS_KM) -> DataFrame:
    """Listings with a point but without a town get town, district and street of the nearest address of the register (id, city,
    voivodeship, district, street, lat, lon); what a listing tells itself stays."""
    found = nearest(df.where("city is null"), register, km, save).select(F.col("a_id").alias("id"), "b_id")
    fields = [c for c in ("city", "district", "street", "voivodeship") if c in df.columns and c in register.columns]
    told = found.join(register.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"r_{c}") for c in fields)), "b_id").drop("b_id")
    return df.join(told, "id", "left").select(*(F.coalesce(F.col(c), F.col(f"r_{c}")).alias(c) if c in fields else F.col(c) for c in df.columns))
