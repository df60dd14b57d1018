"""Streams: landing folder to listings, alerts told once, rate limits of a table, windows over events. Keyed state is in ``state``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.operators import alerts, upsert
from kadastra.operators.search import Filters


def land(spark: SparkSession, path: str, schema, files_per_trigger: int = 50) -> DataFrame:
    """New JSON files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def snapshot_sink(spark: SparkSession, path: str, first: DataFrame, now: Callable[[], str], at: str = "published") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps listings as numbered snapshots under ``path``. A batch that runs again
    rewrites its own snapshot from the one before it, so replays change nothing. Of rows of a batch that repeat a key the
    last by the source's own time (column ``at``) counts."""

    def read(number: int) -> DataFrame:
        return spark.read.parquet(f"{path}/snapshot={number}")

    def run(batch: DataFrame, number: int) -> None:
        current = read(number - 1) if number > 0 else first
        merged = upsert.upsert(current, upsert.latest_per_key(batch, at if at in batch.columns else None), F.lit(now()).cast("timestamp"))
        merged.drop("change", "price_before").write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return run


LOG = "search_id int, id long, channel string, run string, batch int"


def alert_sink(
    spark: SparkSession, path: str, searches: dict[int, Filters], channels: DataFrame, now: Callable[[], str], send: Callable[[DataFrame], None], run: str = "first"
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each (search, listing, channel) to ``send`` once, by a log under ``path``.

    A stream that begins anew with another checkpoint counts its batches from 0 again: give it another ``run``, and what
    earlier runs have told is not told again."""
    spark.createDataFrame([], LOG).drop("run", "batch").write.mode("append").parquet(path)  # the folder is there

    def take(batch: DataFrame, number: int) -> None:
        log = spark.read.schema(LOG).parquet(path)
        found = alerts.untold(alerts.matches(batch, searches, now()), channels, log.where((F.col("run") != run) | (F.col("batch") != number)))
        out = found.select("search_id", "id", "channel")
        out.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")
        send(spark.read.parquet(f"{path}/run={run}/batch={number}"))

    return take


def tumbling(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str = "2 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, limit: int = C.RATE_LIMIT, seconds: int = C.RATE_SECONDS) -> DataFrame:
    """Events with the number of their user's events in the last ``seconds``, and whether that is over the limit."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("refused", F.col("recent") > limit)
