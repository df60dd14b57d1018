"""The engine's tables under one folder, and the usual jobs over them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadastra.operators import market, search, stats, upsert
from kadastra.operators.search import Filters
from kadastra.operators.skew import shared_dir

#: How tables are laid out: partition columns, and the columns that rows are sorted by within files.
LAYOUT = {
    "listings": (("status", "kind"), ("voivodeship", "city", "listed_at")),
    "phones": ((), ("listing_id",)),
    "price_history": ((), ("source_key", "external_id")),
    "market_stats": ((), ("level", "scope")),
    "agencies": ((), ("slug",)),
    "alert_log": ((), ("search_id",)),
    "scan_runs": ((), ("source_key",)),
    "geocode_cache": ((), ("query_hash",)),
}


VERSIONS = "name string, version long, schema string"


class Catalog:
    """Parquet tables in ``root``. Writes go to a new version beside the old one, so a failed job leaves the old one whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _latest(self, name: str):
        log = self.spark.read.schema(VERSIONS).json(f"{self.root}/_versions").where(F.col("name") == name)
        return log.agg(F.max(F.struct("version", "schema")).alias("last")).first()["last"]

    def version(self, name: str) -> int | None:
        last = self._latest(name)
        return last and last["version"]

    def table(self, name: str) -> DataFrame:
        last = self._latest(name)
        if last is None:
            raise KeyError(name)
        schema = T.StructType.fromJson(json.loads(last["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/version={last['version']}").select(*schema.names)

    def create(self) -> None:
        self.spark.createDataFrame([], VERSIONS).write.mode("append").json(f"{self.root}/_versions")

    def save(self, name: str, df: DataFrame) -> None:
        parts, order = LAYOUT.get(name, ((), ()))
        keys = [c for c in order if c in df.columns]
        number = (self.version(name) or 0) + 1
        rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts and set(parts) <= set(df.columns) else writer).parquet(f"{self.root}/{name}/version={number}")
        self.spark.createDataFrame([(name, number, df.schema.json())], VERSIONS).write.mode("append").json(f"{self.root}/_versions")

    def scan(self, batch: DataFrame, now: Column, complete: list[str] = ()) -> None:
        """Take in a batch: upsert, price history, missing offers of completely scanned sources, new medians. Of rows that
        repeat a key the one published last counts. One job at a time may write a catalogue."""
        if not self.spark.sparkContext.getCheckpointDir():
            self.spark.sparkContext.setCheckpointDir(shared_dir(self.spark))
        once = upsert.latest_per_key(batch, "published" if "published" in batch.columns else "listed_at" if "listed_at" in batch.columns else None)
        merged = upsert.upsert(self.table("listings"), once, now).checkpoint()  # read by two writes
        changes = upsert.price_changes(merged, now)
        if self.version("price_history") is not None:
            changes = self.table("price_history").unionByName(changes, allowMissingColumns=True)
        self.save("price_history", changes)
        self.save("listings", upsert.mark_missing(merged.drop("change", "price_before"), now, list(complete)))
        self.save("market_stats", market.medians(self.table("listings")))

    def search(self, f: Filters, now: str) -> DataFrame:
        return search.page(market.score(self.table("listings"), self.table("market_stats")), f, now)

    def stats(self, now: str) -> DataFrame:
        return stats.totals(self.table("listings"), now)
