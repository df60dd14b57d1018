"""Idempotent passes that mend stored listings. Each takes and returns listings; changed rows can be counted by comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import dates, geo, numbers, text
from kadastra.operators import duplicates, locate, places


def _set(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    kept = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(kept, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})




def prices(df: DataFrame) -> DataFrame:
    """Prices that nobody asks become null."""
    return _set(df, ~numbers.plausible_price(F.col("price")), price=F.lit(None).cast("double"))


def rates(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_m2", numbers.price_per_m2(F.col("price"), F.col("area")))


def land_area(df: DataFrame) -> DataFrame:
    """For land the larger of both areas counts, as both."""
    land = F.col("property_type").isin(*C.LAND_TYPES)
    size = F.greatest("area", "plot_area")
    return _set(df, land & size.isNotNull(), area=size, plot_area=size)


def areas(df: DataFrame) -> DataFrame:
    """An implausible area is read again from the title."""
    again = numbers.area(F.col("title"))
    good = F.when(numbers.plausible_area(again, F.col("property_type")), again)
    return _set(df, ~numbers.plausible_area(F.col("area"), F.col("property_type")), area=good)


def navigation(df: DataFrame) -> DataFrame:
    return _set(df, (F.col("status") == "aktywna") & F.col("title").rlike(C.NAVIGATION), status=F.lit("archiwalna"))


def titles(df: DataFrame) -> DataFrame:
    return df.withColumn("title", text.clean(text.unescape(F.col("title"))))


def scripts(df: DataFrame) -> DataFrame:
    """Descriptions that hold code of a page become null."""
    told = F.lower("description")
    return _set(df, F.coalesce(told.contains("$(function") | told.contains("$(document)") | told.contains("{ margin"), F.lit(False)), description=F.lit(None).cast("string"))


def old_notices(df: DataFrame, now: Column) -> DataFrame:
    return _set(df, (F.col("kind") == "wykaz") & (F.col("listed_at") < now - F.expr("interval 365 days")) & (F.col("status") == "aktywna"), status=F.lit("archiwalna"))


def outside(df: DataFrame) -> DataFrame:
    """Points outside Poland become null."""
    return _set(df, ~geo.in_poland(F.col("lat"), F.col("lon")), lat=F.lit(None).cast("double"), lon=F.lit(None).cast("double"))


def outside_region(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points outside their region's box become null; ``boxes`` has one row per region (sixteen)."""
    b = boxes.select("voivodeship", "lat_min", "lat_max", "lon_min", "lon_max")
    joined = df.join(b, "voivodeship", "left")
    out = ~geo.in_box(F.col("lat"), F.col("lon"), F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    return _set(joined, out, lat=F.lit(None).cast("double"), lon=F.lit(None).cast("double")).select(*df.columns)


def stale_points(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Points that differ from the cached point of today's address are replaced by it; ``cache`` has query_hash, lat, lon."""
    key = text.digest(text.norm_key(F.concat_ws(", ", "street", "city", "voivodeship")))
    c = cache.select(F.col("query_hash").alias("h"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    joined = df.join(c, key == F.col("h"), "left")
    off = (F.abs(F.col("lat") - F.col("c_lat")) > C.STALE_POINT) | (F.abs(F.col("lon") - F.col("c_lon")) > C.STALE_POINT)
    return _set(joined, off & ~F.col("geo_precision").eqNullSafe("portal"), lat=F.col("c_lat"), lon=F.col("c_lon")).select(*df.columns)


def county_as_city(df: DataFrame, counties: list[str]) -> DataFrame:
    """A county's name in the town column moves to the county column."""
    return _set(df, F.col("city").isin(*counties), county=F.coalesce("county", "city"), city=F.lit(None).cast("string"))


POINT = {"lat": "double", "lon": "double", "geo_precision": "string"}


def _no_point(df: DataFrame) -> dict[str, Column]:
    return {c: F.lit(None).cast(t) for c, t in POINT.items() if c in df.columns}


def regions_of_places(df: DataFrame, units: DataFrame) -> DataFrame:
    """Listings with a town but no region get region, county and commune of the registry; a county named in one region only
    tells towns of one name apart, and without it those stay open."""
    open_ = F.col("city").isNotNull() & F.col("voivodeship").isNull()
    counties = places.known(units).where("unit_kind = 'powiat'").groupBy("unit_key").agg(F.min("unit_region").alias("lo"), F.max("unit_region").alias("hi")).where("lo = hi").select("unit_key", F.col("lo").alias("county_region"))
    asked = df.where(open_).join(places.small(counties), places.name_key(F.col("county")) == F.col("unit_key"), "left").select("city", "county", "county_region").distinct()
    found = places.resolve(asked, units, "city", "county_region").where("unit_region is not null").select(F.col("city").alias("of_city"), F.col("county").alias("of_county"), "unit_region", F.col("unit_county").alias("found_county"), F.col("unit_commune").alias("found_commune"))
    joined = df.join(found, open_ & (F.col("city") == F.col("of_city")) & F.col("county").eqNullSafe(F.col("of_county")), "left")
    new = {"voivodeship": F.coalesce("voivodeship", "unit_region"), "county": F.coalesce("county", F.when(F.col("unit_region").isNotNull(), F.col("found_county"))), "commune": F.coalesce(F.col("found_commune"), *([F.col("commune")] if "commune" in df.columns else []))}
    return joined.select(*((new[c].alias(c) if c in new else F.col(c)) for c in df.columns))


def _moved(df: DataFrame, found: DataFrame, sure: Column) -> DataFrame:
    """Listings moved to what ``found`` (of, new_city, new_county, new_commune, new_region) says where ``sure``; the point goes."""
    joined = df.join(found, F.col("id") == F.col("of"), "left")
    differs = ~(F.col("new_city").eqNullSafe(F.col("city")) & F.col("new_region").eqNullSafe(F.col("voivodeship")))
    go = F.coalesce(sure & F.col("new_city").isNotNull() & differs, F.lit(False))
    new = {"city": F.col("new_city"), "county": F.col("new_county"), "commune": F.col("new_commune"), "voivodeship": F.col("new_region"), **_no_point(df)}
    return joined.select(*((F.when(go, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)) for c in df.columns))


def relocate_by_title(df: DataFrame, units: DataFrame, portals: list[str]) -> DataFrame:
    """Listings of sources that give no town are placed again by their titles, where these name a town or have a cue."""
    asked = df.where(~F.col("source_key").isin(*portals)).select(F.col("id").cast("string").alias("part"), F.col("title").alias("body"), F.lit(None).cast("string").alias("hint"))
    found = locate.detect(asked, units).where(F.col("basis").isin("miasto", "wskazówka"))
    found = found.select(F.col("part").cast("long").alias("of"), F.col("place").alias("new_city"), F.col("county").alias("new_county"), F.col("commune").alias("new_commune"), F.col("region").alias("new_region"))
    return _moved(df, found, F.lit(True))


def relocate_by_address(df: DataFrame, addresses: DataFrame, units: DataFrame) -> DataFrame:
    """Listings whose stored page has an address (``addresses``: id, city, voivodeship) are placed by it."""
    settled = locate.where_it_lies(addresses.where("length(trim(city)) > 0").select(F.col("id").alias("of"), "city", "voivodeship"), units)
    found = settled.select("of", F.col("city").alias("new_city"), F.col("county").alias("new_county"), F.col("commune").alias("new_commune"), F.col("voivodeship").alias("new_region"))
    return _moved(df, found, F.lit(True))


def restore_city(df: DataFrame, units: DataFrame, sources: list[str]) -> DataFrame:
    """Listings without a town get that part of their street and district which the registry has as a place; the parts left
    over are district and street. Nothing is guessed where the registry knows none."""
    asked = F.col("city").isNull() & F.col("source_key").isin(*sources) & (F.col("street").isNotNull() | F.col("district").isNotNull())
    parts = F.filter(F.transform(F.concat(F.split(F.coalesce("street", F.lit("")), ","), F.array(F.coalesce("district", F.lit("")))), text.clean), lambda p: p != "")
    each = df.where(asked).select(F.col("id").alias("of"), F.col("voivodeship").alias("region"), parts.alias("parts")).select("of", "region", "parts", F.posexplode("parts").alias("at", "part"))
    known = places.known(units).where("unit_kind <> 'powiat'").select("unit_key").distinct()
    last = each.join(places.small(known), places.name_key(F.col("part")) == F.col("unit_key")).groupBy("of", "region", "parts").agg(F.max_by("part", "at").alias("town"))
    unit = places.resolve(last, units, "town", "region")
    rest = F.filter("parts", lambda p: p != F.col("town"))
    found = unit.select("of", F.coalesce("unit_name", "town").alias("new_city"), F.col("unit_county").alias("new_county"), F.col("unit_commune").alias("new_commune"), F.coalesce("unit_region", "region").alias("new_region"), F.try_element_at(rest, F.lit(-1)).alias("new_district"), F.nullif(F.array_join(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), ", "), F.lit("")).alias("new_street"))
    joined = df.join(found, F.col("id") == F.col("of"), "left")
    new = {"city": "new_city", "county": "new_county", "commune": "new_commune", "voivodeship": "new_region", "district": "new_district", "street": "new_street"}
    go = F.col("of").isNotNull()
    return joined.select(*((F.when(go, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.when(go, F.lit(None).cast(POINT[c])).otherwise(F.col(c)).alias(c) if c in POINT else F.col(c)) for c in df.columns))


def default_region(df: DataFrame, units: DataFrame, boxes: DataFrame, region: str = "opolskie", code: str = "16") -> DataFrame:
    """Listings that carry a default region which nothing speaks for: that of their code, or of the one box that holds their
    point, or of the registry's only region with such a town; otherwise none. County and commune go with it."""
    held = boxes.limit(places.MAX_BOXES + 1).collect()
    if len(held) > places.MAX_BOXES:
        raise ValueError(f"over {places.MAX_BOXES} boxes")
    near = F.array_compact(F.array(*(F.when(F.col("lat").between(b["lat_min"], b["lat_max"]) & F.col("lon").between(b["lon_min"], b["lon_max"]), b["voivodeship"]) for b in sorted(held, key=lambda b: b["voivodeship"]))))
    of_code = places.small(units.where("voivodeship is not null").select(F.substring("teryt", 1, 2).alias("code"), F.col("voivodeship").alias("code_region")).distinct())
    towns = places.known(units).groupBy("unit_key").agg(F.min("unit_region").alias("lo"), F.max("unit_region").alias("hi"), F.max(F.col("unit_region") == region).alias("here"))
    rows = df.join(of_code, F.substring("teryt", 1, 2) == F.col("code"), "left").join(places.small(towns), places.name_key(F.col("city")) == F.col("unit_key"), "left")
    has_point = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    by_point = F.when(F.array_contains(near, region), region).when(F.size(near) == 1, F.get(near, 0))
    by_town = F.when(F.coalesce("here", F.lit(False)), region).when(F.col("lo") == F.col("hi"), F.col("lo"))
    target = F.when(F.col("teryt").startswith(code), region).when(F.col("teryt").isNotNull(), F.coalesce("code_region", F.lit(region))).when(has_point, by_point).otherwise(by_town)
    go = (F.col("voivodeship") == region) & ~F.coalesce(target == region, F.lit(False))
    new = {"voivodeship": target, "county": F.lit(None).cast("string"), "commune": F.lit(None).cast("string")}
    return rows.select(*((F.when(go, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)) for c in df.columns))


def recheck_links(df: DataFrame, links: DataFrame) -> DataFrame:
    """The links (original_id, copy_id) that today's rules still make; ``df`` has fingerprints. Links to what is gone go too."""
    row = lambda side: df.select(F.col("id").alias(f"{side}_key"), F.struct(*(F.col(c) for c in (*duplicates.COLUMNS, "fingerprint", "text_shingle"))).alias(side))
    pairs = links.select("original_id", "copy_id").distinct().join(row("a"), F.col("original_id") == F.col("a_key")).join(row("b"), F.col("copy_id") == F.col("b_key"))
    kept = duplicates.verdicts(pairs.select("a", "b"))
    return kept.select(F.col("a_id").alias("original_id"), F.col("b_id").alias("copy_id"), "method", "score")


def dates_from_raw(df: DataFrame, now: Column, paths: dict[str, dict[str, list[str]]], local: tuple[str, ...] = (), naive_local: tuple[str, ...] = ()) -> DataFrame:
    """Dates read again from the stored answers: ``paths`` has, for each source, the columns and the JSON paths to try. Columns in
    ``local`` are Warsaw wall clocks; sources in ``naive_local`` give Warsaw times without a zone."""
    out: dict[str, Column] = {}
    for source, fields in paths.items():
        for field, tried in fields.items():
            told = F.coalesce(*(F.nullif(F.get_json_object("raw", f"$.{p}"), F.lit("")) for p in tried))
            moment = dates.parse_moment(told, now.cast("timestamp"), naive_local=source in naive_local)
            if field in local:
                wall = F.try_to_timestamp(F.substring(F.translate(told, "T", " "), 1, 19)).cast("timestamp_ntz")
                moment = F.when(told.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?$"), wall).otherwise(dates.to_warsaw(moment))
            kept = out.get(field, F.col(field))
            out[field] = F.when((F.col("source_key") == source) & told.isNotNull() & moment.isNotNull(), moment.cast(dict(df.dtypes)[field])).otherwise(kept)
    return df.withColumns({c: v for c, v in out.items() if c in df.columns})


def future_dates(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("published", dates.not_in_future(F.col("published"), now)) if "published" in df.columns else df


def unswap(df: DataFrame, now: Column, column: str = "published", marker: str = "unswapped") -> DataFrame:
    """Day and month changed over once for dates in the future that are past the other way round; a marker says it is done."""
    d = F.col(column)
    other = F.expr(f"try_make_timestamp(year({column}), day({column}), month({column}), hour({column}), minute({column}), second({column}))").cast(dict(df.dtypes)[column])
    wrong = (d > now) & (F.day(d) <= 12) & (other <= now)
    marked = df if marker in df.columns else df.withColumn(marker, F.lit(False))
    return _set(marked, wrong & ~F.col(marker), **{column: other}).withColumn(marker, F.col(marker) | F.coalesce(wrong, F.lit(False)))


def listed(df: DataFrame) -> DataFrame:
    return df.withColumn("listed_at", dates.listed_at(F.col("published"), F.col("first_seen"))) if "published" in df.columns else df


def markets(df: DataFrame) -> DataFrame:
    """Market names without accents."""
    return df.withColumn("market", text.fold(F.col("market"))) if "market" in df.columns else df


PASSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "prices": prices, "areas": areas, "land_area": land_area, "rates": rates, "navigation": navigation, "titles": titles, "scripts": scripts,
    "outside": outside, "listed": listed, "markets": markets,
}


def all_passes(df: DataFrame, needed: tuple[str, ...] = ("area", "plot_area", "title", "description", "property_type", "lat", "lon", "status")) -> DataFrame:
    """All passes that need nothing but the listings, in order; columns that a listing lacks are added as null."""
    kinds = {"area": "double", "plot_area": "double", "lat": "double", "lon": "double"}
    for c in needed:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    for step in PASSES.values():
        df = step(df)
    return df


#: Where a row's values are kept while the passes run over it.
BEFORE = "row_before_repair"


def _counted(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[Column]]:
    """``all_passes`` over rows that carry their own values along, and the number of changed rows by column."""
    kept = [c for c in columns if c in df.columns]
    after = all_passes(df.withColumn(BEFORE, F.struct(*kept)) if kept else df)
    return after, [F.count_if(~F.col(c).eqNullSafe(F.col(f"{BEFORE}.{c}")) if c in kept else F.col(c).isNotNull()).alias(c) for c in columns]


def change_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows that ``all_passes`` changes, by column; one scan, no join, and ids need not be unique."""
    after, counts = _counted(df, columns)
    return after.agg(*counts)


def observed(df: DataFrame, columns: list[str], name: str = "repairs") -> tuple[DataFrame, Observation]:
    """``all_passes``, and the number of rows that it changes by column, counted in passing when its result is written
    (``Observation.get``). A result that is written twice tells the counts of the first time."""
    told = Observation(name)
    after, counts = _counted(df, columns)
    return after.observe(told, *counts).drop(BEFORE), told
