"""Similar offers: candidates by bands and place, the nearest of them, and not twice the same property."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions.geo import haversine_km

#: Types whose number of rooms matters.
ROOMS_MATTER = ("mieszkanie", "dom")
ANCHOR = ("id", "kind", "property_type", "transaction", "price", "area", "rooms", "city", "county", "voivodeship", "lat", "lon", "district")


def relative_gap() -> Column:
    price = F.when(F.col("a_price") > 0, F.abs(F.coalesce("price", F.lit(0.0)) - F.col("a_price")) / F.col("a_price")).otherwise(0.0)
    size = F.when(F.col("a_area") > 0, F.abs(F.coalesce("area", F.lit(0.0)) - F.col("a_area")) / F.col("a_area")).otherwise(0.0)
    return price + size


def _at(prefix: str) -> Column:
    """The places at which a row can be met, nearest first: its town (with the region if known), county and region."""
    c = lambda name: F.col(f"{prefix}{name}")
    town = F.concat(F.lit("0|"), c("city"), F.lit("|"), F.coalesce(c("voivodeship"), F.lit("")))
    keys = [town, F.concat(F.lit("1|"), c("county")), F.concat(F.lit("2|"), c("voivodeship"))]
    if not prefix:  # an anchor without region asks with its town alone
        keys.append(F.when(c("voivodeship").isNotNull(), F.concat(F.lit("0|"), c("city"), F.lit("|"))))
    return F.array_compact(F.array(*keys))


def candidates(df: DataFrame, anchors: DataFrame, levels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Active originals at the given ``levels`` of the anchors' kind, type and transaction within the bands, with the nearest place they share as
    ``level`` (0 town, 1 county, 2 region). Prices are bucketed by the logarithm, so the join is on equal keys: a band
    spans the bucket of the anchor and its neighbours. Anchors without a price take any price, those without an area any area."""
    bucket = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1.0))) / F.log(F.lit(C.SIMILAR_HIGH / 1.0))).cast("int")
    around = F.when(F.col("price").isNotNull(), F.array(*(bucket("price") + i for i in (-2, -1, 0, 1)))).otherwise(F.array(F.lit(None).cast("int")))
    wanted = lambda keys: F.filter(keys, lambda k: F.substring(k, 1, 1).isin(*map(str, levels)))
    asked = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ANCHOR), F.explode(around).alias("a_bucket")).withColumn("a_at", F.explode(wanted(_at("a_"))))
    extra = [c for c in ("images",) if c in df.columns]
    rows = df.where((F.col("status") == "aktywna") & F.col("is_original")).withColumn("at", F.explode(wanted(_at(""))))
    on = [F.col("at") == F.col("a_at"), *(F.col(c) == F.col(f"a_{c}") for c in ("kind", "property_type", "transaction"))]
    priced = rows.where("price is not null").withColumn("bucket", bucket("price")).join(asked.where("a_price is not null"), [F.col("bucket") == F.col("a_bucket"), *on]).drop("bucket")
    unpriced = rows.join(asked.where("a_price is null"), on)
    joined = priced.unionByName(unpriced)
    rooms = F.when(F.col("a_property_type").isin(*ROOMS_MATTER), F.col("rooms").isNull() | F.col("a_rooms").isNull() | (F.abs(F.col("rooms") - F.col("a_rooms")) <= 1)).otherwise(True)
    band = lambda c: F.col(f"a_{c}").isNull() | F.coalesce(F.col(c).between(F.col(f"a_{c}") * C.SIMILAR_LOW, F.col(f"a_{c}") * C.SIMILAR_HIGH), F.lit(False))
    town = F.coalesce((F.col("city") == F.col("a_city")) & (F.col("a_voivodeship").isNull() | (F.col("voivodeship") == F.col("a_voivodeship"))), F.lit(False))
    nearest = F.when(town, 0).when(F.coalesce(F.col("county") == F.col("a_county"), F.lit(False)), 1).otherwise(2)
    level = F.substring("a_at", 1, 1).cast("int")
    found = joined.where((F.col("id") != F.col("a_id")) & band("price") & band("area") & rooms & (level == nearest))
    return found.withColumn("level", level).drop("at", "a_at", "a_bucket").select("*", *([] if extra else [F.lit(None).cast("array<string>").alias("images")]))


def closeness() -> Column:
    """Distance in price, area, rooms and place, and a little for offers without pictures; the smaller the more alike."""
    price = F.coalesce(F.abs(F.log(F.col("price") / F.col("a_price"))), F.lit(0.0))
    size = F.when(F.col("a_area") > 0, F.when(F.col("area") > 0, F.abs(F.log(F.col("area") / F.col("a_area")))).otherwise(0.5)).otherwise(0.0)
    asks_rooms = (F.col("a_rooms") > 0) & F.col("a_property_type").isin(*ROOMS_MATTER)
    rooms = F.when(asks_rooms, F.coalesce(0.15 * F.abs(F.col("rooms") - F.col("a_rooms")), F.lit(0.1))).otherwise(0.0)
    away = F.coalesce(F.least(haversine_km(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")), F.lit(40.0)) / 40, F.lit(0.0))
    district = F.when(F.col("district") == F.col("a_district"), 0.1).otherwise(0.0)
    bare = F.when(F.coalesce(F.size("images"), F.lit(0)) > 0, 0.0).otherwise(0.25)
    return price + size + rooms + away - district + bare


def pools(df: DataFrame, anchors: DataFrame, pool: int = C.SIMILAR_POOL, levels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The nearest ``pool`` candidates of each anchor and level, with closeness."""
    w = Window.partitionBy("a_id", "level").orderBy(relative_gap(), "id")
    found = candidates(df, anchors, levels).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= pool).drop("__n")
    return found.withColumn("closeness", closeness())


def same_property(price_a, area_a, city_a, price_b, area_b, city_b) -> bool:
    """Whether two offers are one property told twice; offers without price or area are never taken for one."""
    if not (price_a and price_b and area_a and area_b):
        return False
    return abs(price_a - price_b) <= 0.005 * price_a and abs(area_a - area_b) < 1.0 and (city_a or "").lower() == (city_b or "").lower()


CHOSEN = "a_id long, a_price double, a_area double, a_city string, id long, price double, area double, city string, level int, closeness double"


def similar(df: DataFrame, anchors: DataFrame, save: Callable[[DataFrame], DataFrame], most: int = C.SIMILAR_LIMIT) -> DataFrame:
    """Up to ``most`` similar offers of each anchor: (a_id, id, level, closeness, place), nearest levels first, leaving
    out the anchor's own property and what was already taken. Each anchor's pool is bounded, so a group fits a task.

    The levels are gone through one by one: an anchor that its town fills never asks its county, nor its region. ``save`` has
    to cut lineage (a checkpoint or a written table)."""

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        kept = []
        first = pool.iloc[0]
        seen = [(first["a_price"], first["a_area"], first["a_city"])]
        none = lambda x: None if pd.isna(x) else x
        pool = pool.sort_values(["level", "closeness", "id"])
        for k, r in enumerate(pool.itertuples()):
            own = (none(r.price), none(r.area), r.city)
            if any(same_property(*map(none, s), *own) for s in [*seen, *taken]):
                continue
            taken.append(own)
            kept.append(k)
            if len(kept) == most:
                break
        return pool.iloc[kept].assign(place=range(1, len(kept) + 1))

    columns = [c.split()[0] for c in CHOSEN.split(", ")]
    open_, before, out = anchors, None, None
    for level in (0, 1, 2):
        pool = pools(df, open_, levels=(level,)).select(*columns)
        if before is not None:  # what nearer levels gave is chosen again, first
            pool = pool.unionByName(before.select(*columns))
        chosen = save(pool.groupBy("a_id").applyInPandas(pick, CHOSEN + ", place int"))
        if level == 2:
            out = chosen if out is None else out.unionByName(chosen)
            return out.select("a_id", "id", "level", "closeness", "place")
        full = chosen.where(F.col("place") == most).select("a_id")
        done = chosen.join(full, "a_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        before = chosen.join(full, "a_id", "left_anti")
        open_ = save(open_.join(full.withColumnRenamed("a_id", "id"), "id", "left_anti").select(*anchors.columns))
