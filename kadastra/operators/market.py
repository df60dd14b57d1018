"""Price references: medians by town, county and region, and how listings compare with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions.numbers import half_up
from kadastra.operators import stats

KEYS = ("level", "scope", "property_type", "transaction")


def scopes() -> Column:
    """The keys of a listing at each level; null where it has none."""
    region = F.col("voivodeship")
    key = lambda c: F.when(F.col(c).isNotNull() & region.isNotNull(), F.concat_ws("|", c, region))
    return F.array(*(F.struct(F.lit(level).alias("level"), scope.alias("scope")) for level, scope in zip(C.MARKET_LEVELS, (key("city"), key("county"), region), strict=True)))


def comparable(df: DataFrame) -> Column:
    """Listings that medians are made of: no kiosks, allotments or lodgings, whatever type they are filed under."""
    other = F.coalesce(F.col("title").rlike(C.NOT_COMPARABLE), F.lit(False)) if "title" in df.columns else F.lit(False)
    return ~other & (F.col("status") == "aktywna") & (F.col("price_per_m2") > 0) & F.col("property_type").isin(*C.COMPARABLE_TYPES)


def medians(df: DataFrame, least: int = C.MIN_SAMPLE) -> DataFrame:
    """Median price per square metre of every level, scope, type and transaction with enough listings.

    A row goes to three keys that do not nest, so it is exploded; equal prices are counted before the shuffle.
    """
    rows = df.where(comparable(df)).select(F.explode(scopes()).alias("at"), "property_type", "transaction", "price_per_m2").select("at.*", "property_type", "transaction", "price_per_m2")
    found = stats.medians(rows.where("scope is not null"), list(KEYS), "price_per_m2")
    return found.where(F.col("n") >= least)


def references(df: DataFrame, known: DataFrame) -> DataFrame:
    """Listings with the median of the first level that has one: columns median, level and sample.

    One join instead of three: each listing asks with its three keys, and the best level answers.
    """
    asked = df.where(comparable(df)).select("id", F.posexplode(scopes()).alias("rank", "at"), "property_type", "transaction").select("id", "rank", "at.*", "property_type", "transaction")
    answers = asked.join(known, list(KEYS)).groupBy("id").agg(F.min(F.struct("rank", "level", "median", "n")).alias("best"))
    return df.join(answers, "id", "left").select(df["*"], F.col("best.median").alias("market_median"), F.col("best.level").alias("deal_level"), F.col("best.n").alias("market_sample"))


def score(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Listings with deal_ratio (price per square metre over the median, 3 decimals; null under MIN_RATIO) and deal_level."""
    found = references(df, medians(df) if known is None else known)
    ratio = half_up(F.col("price_per_m2") / F.col("market_median"), 3)
    return found.withColumn("deal_ratio", F.when(ratio >= C.MIN_RATIO, ratio)).withColumn("deal_level", F.when(F.col("deal_ratio").isNotNull(), F.col("deal_level")))


def is_bargain() -> Column:
    return (F.col("deal_ratio") <= C.BARGAIN_RATIO) & F.col("deal_level").isin("miasto", "powiat") & (F.col("status") == "aktywna") & F.col("is_original")


def levels(known: DataFrame, city: str | None, county: str | None, voivodeship: str, kind: str, transaction: str) -> DataFrame:
    """The medians of one place in the order of levels; the county is left out where it is the town."""
    scope = {"miasto": city and f"{city}|{voivodeship}", "powiat": county and county != city and f"{county}|{voivodeship}", "wojewodztwo": voivodeship}
    asked = [F.when((F.col("level") == level) & (F.col("scope") == s), i) for i, (level, s) in enumerate(scope.items()) if s]
    return known.where((F.col("property_type") == kind) & (F.col("transaction") == transaction)).withColumn("rank", F.coalesce(*asked)).where("rank is not null")


def stale(scored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Listings that had a score and have none now."""
    return scored.where("deal_ratio is not null").join(fresh.where("deal_ratio is not null"), "id", "left_anti")
