"""Saved searches against new listings, each pair told once per channel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.operators.search import Filters, order, search


def matches(new: DataFrame, searches: dict[int, Filters], now: str, most: int = C.ALERT_LIMIT) -> DataFrame:
    """(search_id, id) of the newest ``most`` listings per saved search. Each search is a filter over the new rows, never a product."""
    if not searches:
        return new.select(F.lit(0).alias("search_id"), "id").limit(0)
    found = [search(new, f, now).select(F.lit(k).alias("search_id"), "id", "listed_at") for k, f in searches.items()]
    rows = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("search_id").orderBy(*order("najnowsze", now))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("search_id", "id")


def untold(found: DataFrame, channels: DataFrame, log: DataFrame) -> DataFrame:
    """(search_id, id, channel) that the log does not hold yet."""
    return found.join(channels, "search_id").join(log.select("search_id", "id", "channel"), ["search_id", "id", "channel"], "left_anti")


def message(df: DataFrame) -> DataFrame:
    """One line of text per listing."""
    money = F.concat(F.format_number("price", 0), F.lit(" zł"))
    size = F.concat(F.format_number("area", 1), F.lit(" m²"))
    return df.select("id", F.concat_ws(" · ", "title", money, size, F.concat_ws(", ", "street", "city")).alias("message"))
