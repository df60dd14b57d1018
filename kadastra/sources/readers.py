"""Landed documents read by the reader that the registry names for their source, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.sources import cards, pages, payloads

#: What is landed: the source, the address, the text as it was fetched, and the phrase that was searched for, if one was.
LANDED = "source_key string, url string, body string, phrase string"
#: A source of the registry; the selectors of those that are read by them stand in a table of their own (cards.SOURCE).
SOURCE = "key string, scraper string, enabled boolean"
#: Sources that a registry may have.
MOST_SOURCES = 100_000

_OWN = ("source_key",)
Reader = Callable[[DataFrame], DataFrame]
#: Readers by the name that the registry gives them. Each takes LANDED and returns offers with source_key.
READERS: dict[str, Reader] = {
    "portal": lambda df: payloads.portal_offers(df, "body", keep=_OWN),
    "state": lambda df: payloads.state_offers(df, "body", keep=_OWN),
    "json_ld": lambda df: pages.json_ld_offers(df, "body", keep=_OWN).withColumn("external_id", F.col("url")).drop("page_url"),
    "rest": lambda df: pages.rest_offers(df, "body", keep=_OWN),
    "official_auctions": lambda df: payloads.official_auctions(df, "body", keep=_OWN),
    "bailiff_auctions": lambda df: payloads.bailiff_auctions(df, "body", keep=_OWN),
    "notices_by_phrase": lambda df: payloads.notices_by_phrase(df, "phrase", "body", keep=_OWN),
    "notices_by_word": lambda df: payloads.notices_by_word(df, "body", keep=_OWN),
}
#: The reader of sources that are described by selectors.
BY_SELECTORS = "generic"


def land(df: DataFrame, path: str) -> None:
    """Append fetched documents (LANDED) to a folder with a partition for each source."""
    df.write.partitionBy("source_key").mode("append").json(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).json(path)


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same rows as ``landed`` as a stream of new files."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).json(path)


def by_reader(sources: DataFrame) -> dict[str, list[str]]:
    """The enabled sources of each reader. The registry is configuration and is read by the driver; over MOST_SOURCES are refused, and
    so is a reader that nobody knows."""
    rows = sources.where("enabled").select("key", "scraper").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a registry of over {MOST_SOURCES} sources")
    found: dict[str, list[str]] = {}
    for r in sorted(rows):
        found.setdefault(r["scraper"], []).append(r["key"])
    unknown = sorted(set(found) - set(READERS) - {BY_SELECTORS})
    if unknown:
        raise ValueError(f"no reader named {', '.join(unknown)}")
    return found


def read(documents: DataFrame, sources: DataFrame, now: Column, selectors: DataFrame | None = None) -> DataFrame:
    """Offers of landed documents (LANDED), each read by its source's reader; columns that a reader does not tell are null, and
    ``scraper`` says which one it was.

    Documents of sources that are disabled or not in the registry give nothing, like documents that their reader cannot make out.
    There is one branch for each reader in use, not for each source; in a folder written by ``land`` it lists only the partitions
    of its own sources.
    """
    parts = []
    for name, keys in by_reader(sources).items():
        own = documents.where(F.col("source_key").isin(keys))
        if name != BY_SELECTORS:
            parts.append(READERS[name](own).withColumn("scraper", F.lit(name)))
        elif selectors is not None:
            parts.append(cards.offers(own.withColumnRenamed("body", "html"), selectors.where(F.col("source_key").isin(keys)), now).withColumn("scraper", F.lit(name)))
        else:
            raise ValueError(f"sources of the reader {name} need their selectors")
    if not parts:
        return documents.sparkSession.createDataFrame([], "source_key string, url string, external_id string, title string, price double, scraper string")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def offers_sink(path: str, sources: DataFrame, now: Callable[[], str], selectors: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the documents of a batch into ``path``/batch=N; a batch that runs again replaces its own."""

    def take(batch: DataFrame, number: int) -> None:
        read(batch, sources, F.lit(now()).cast("timestamp"), selectors).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take
