"""Counts and reports over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.functions import dates, text


#: Width of the ranges of values in which an upper median is looked for.
RANGE = 1000.0
#: Groups that are broadcast at most.
BROADCAST_GROUPS = 1_000_000


def upper_medians(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, upper_median): the value at place n div 2 + 1 of each group.

    Rows are counted by range, the ranges' counts added up, and the one range that holds the place is looked at by value;
    so no group is sorted in one task.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v"), F.floor(F.col(column) / RANGE).alias("range"))
    w = Window.partitionBy("k")

    def reached(counts: DataFrame, by: str, place: Column) -> DataFrame:
        """The first row of each group whose running count reaches ``place``, with the count before it."""
        up = counts.withColumn("sum", F.sum("n").over(w.orderBy(by))).withColumn("place", place)
        return up.where((F.col("place") <= F.col("sum")) & (F.col("place") > F.col("sum") - F.col("n")))

    ranges = reached(rows.groupBy("k", "range").agg(F.count("*").alias("n")), "range", F.floor(F.sum("n").over(w) / 2) + 1)
    ranges = ranges.select(F.col("k").alias("of"), F.col("range").alias("in_range"), (F.col("place") - F.col("sum") + F.col("n")).alias("rest"))
    inner = rows.join(F.broadcast(ranges) if ranges.count() <= BROADCAST_GROUPS else ranges, F.col("k").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    found = reached(inner.groupBy("k", "v").agg(F.count("*").alias("n"), F.max("rest").alias("rest")), "v", F.col("rest"))
    return found.select(F.col("k").alias(key), F.col("v").alias("upper_median"))


#: Ranges of positive values between a number and its double, in which a median is looked for.
RANGES_A_DOUBLING = 32


def medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, median, n): the mean of the one or two middle values of each group, of the rows with a positive ``column``.

    Equal values are counted first, which Spark does before the shuffle; ranges of values are added up from these counts, and
    only the ranges that hold a middle place are looked at by value. So no task holds or sorts the values of a group: its windows
    see the ranges (some dozens for prices) and the different values of one or two ranges.
    """
    values = df.where(F.col(column) > 0).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.log2("v") * RANGES_A_DOUBLING))
    group = Window.partitionBy(*keys)
    up = values.groupBy(*keys, "range").agg(F.sum("n").alias("n")).withColumns({"sum": F.sum("n").over(group.orderBy("range")), "total": F.sum("n").over(group)})
    middle = (F.col("sum") >= F.floor((F.col("total") + 1) / 2)) & (F.col("sum") - F.col("n") <= F.floor(F.col("total") / 2))
    held = up.where(middle).select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("range").alias("in_range"), (F.col("sum") - F.col("n")).alias("below"), "total")
    met = F.col("range") == F.col("in_range")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inner = values.join(held, met).withColumn("sum", F.sum("n").over(group.orderBy("v")) + F.min("below").over(group))
    return inner.where(middle).groupBy(*keys).agg((F.min("v") * 0.5 + F.max("v") * 0.5).alias("median"), F.max("total").alias("n"))


def totals(df: DataFrame, now: str) -> DataFrame:
    """All dashboard counts in one pass."""
    active, moment = F.col("status") == "aktywna", F.lit(now).cast("timestamp")
    original = active & F.col("is_original")
    flats = original & (F.col("property_type") == "mieszkanie") & (F.col("transaction") == "sprzedaz")
    return df.agg(
        F.count("*").alias("listings"),
        F.count_if(active).alias("active"),
        F.count_if(original).alias("originals"),
        F.count_if(active & ~F.col("is_original")).alias("copies"),
        F.count_if(active & (F.col("kind") == "licytacja")).alias("auctions"),
        F.count_if(active & F.col("kind").isin("przetarg", "wykaz")).alias("tenders"),
        F.count_if(active & (F.col("listed_at") >= moment - F.expr("interval 7 days"))).alias("this_week"),
        F.count_if(original & (F.col("price") < F.col("initial_price"))).alias("dropped"),
        F.count_if(active & (F.col("seller_type") == "prywatna")).alias("private"),
        F.count_if(active & F.col("phone").isNotNull()).alias("with_phone"),
        F.count_if(active & F.col("lat").isNotNull()).alias("with_point"),
        F.round(F.avg(F.when(flats, F.col("price_per_m2"))), 0).alias("avg_price_m2"),
    )


def counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Active listings by a column; with ``most``, the largest groups."""
    found = df.where((F.col("status") == "aktywna") & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return found if most is None else found.orderBy(F.desc("n"), column).limit(most)


def market_report(df: DataFrame, now: str, days: int, city: str | None = None) -> DataFrame:
    """Originals of the last ``days`` by property type: count, upper median, extremes and mean price, mean days on the
    market, removed ones, share of agencies."""
    moment = F.lit(now).cast("timestamp")
    rows = df.where(F.col("is_original") & (F.col("listed_at") >= moment - F.make_dt_interval(F.lit(days))))
    rows = rows if city is None else rows.where(F.col("city") == city)
    rows = rows.where("price is not null")
    middle = upper_medians(rows, "property_type", "price").withColumnsRenamed({"property_type": "of", "upper_median": "median_price"})
    on_market = dates.whole_days(F.col("listed_at"), moment)
    found = rows.groupBy("property_type").agg(
        F.count("*").alias("n"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        F.round(F.avg(on_market), 1).alias("avg_days"),
        F.count_if(F.col("status") != "aktywna").alias("removed"),
        F.round(100.0 * F.count_if(F.col("seller_type") == "posrednik") / F.count("*"), 1).alias("agency_share"),
    )
    return found.join(middle, F.col("property_type").eqNullSafe(F.col("of")), "left").drop("of")


def completeness(df: DataFrame, columns: list[str], by: str = "source_key") -> DataFrame:
    """Share of rows with a value, in percent, by column and source."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.round(100.0 * F.count(c) / F.count("*"), 2).alias(f"{c}_pct") for c in columns))


def street_suggest(df: DataFrame, begins: str, most: int = 20) -> DataFrame:
    """Streets whose folded label begins so: counted by raw name first, then by label."""
    raw = df.where("street is not null").groupBy("street").agg(F.count("*").alias("n"))
    label = text.street_label(F.col("street"))
    by_label = raw.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))
    return by_label.where(text.fold(F.col("label")).startswith(text.fold(F.lit(begins)))).orderBy(F.desc("n"), "label").limit(most)


def sitemap_groups(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Places with enough offers for a page of their own."""
    found = df.where((F.col("status") == "aktywna") & F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= C.SITEMAP_LEAST).orderBy(F.desc("n"), *columns).limit(most)


def sitemap_chunks(df: DataFrame, size: int = C.SITEMAP_CHUNK, key: str = "id") -> DataFrame:
    """Rows by id in files of exactly ``size`` URLs: (key, chunk). Ids are ranged and counted per range first, so no task numbers all rows."""
    spark = df.sparkSession
    ids = df.select(key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + F.when(F.col(key) > cut, 1).otherwise(0)
    ranged = ids.withColumn("range", bucket)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))  # one row per range
    at = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return ranged.withColumn("at", at).join(offsets, "range").select(key, F.floor((F.col("offset") + F.col("at") - 1) / size).cast("long").alias("chunk"))


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_key").agg(F.max("started_at").alias("started_at"))


def scan_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(*(F.sum(c).alias(c) for c in ("found", "new", "updated", "errors")))
