"""Registered queries that run as streams over a table: keyed state with event-time timers, equal to their batch twins.

The table is landed in a few successive parts, by time, in the shared folder; the watermark's delay is the length of a part,
so no row of a part is too late however its files are dealt to batches. Two last rows of a time far ahead, of a key of their
own, let the watermark pass what is still open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.operators.skew import shared_dir
from kadastra.plans.views import table
from kadastra.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTS = 4
TICK = "tick"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def streamed(rows: DataFrame, at: str, ticks: dict, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What ``make`` (stream, delay) gives for ``rows`` landed part by part; ``ticks`` has the columns of the two last rows."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    lo, hi = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    if lo is None:
        lo = hi = 0
    length = (hi - lo) // PARTS + 1
    part = F.floor((F.unix_micros(at) - lo) / length)
    for k in range(PARTS):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
    for k in (1, 2):
        tick = rows.sparkSession.range(1).select(*((F.timestamp_micros(F.lit(hi + 10 * k * max(length, 10**12))) if c == at else F.lit(ticks.get(c))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
        tick.write.mode("append").parquet(f"{folder}/in")
    state.use_state(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{folder}/in")
    made = make(stream, f"{length // 1_000_000 + 1} seconds")
    run = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


_OFFERS = """o as (select distinct event_type as source_key, cast(user_id as varchar) as external_id, date_trunc('milliseconds', ts) as seen from events),
p as (select source_key, day as ended from (select distinct event_type as source_key from events), (select unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), interval 1 day)) as day from events) where extract(day from day) % 3 <> 0),
n as (select *, lead(seen) over (partition by source_key, external_id order by seen) as later from o),
g as (select n.source_key, external_id, seen as last_seen, min(ended) as removed from n join p on p.source_key = n.source_key and ended > seen + interval 3 day and (later is null or ended < later) group by all)"""


@query("absence_stream", f"with {_OFFERS} select source_key, external_id, last_seen, removed from g")
def _(spark, sf_dir):
    """Users as offers of a source (the type of event); each source is passed over completely on two days of three."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    seen = events.select(F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("external_id"), F.date_trunc("millisecond", "ts").alias("seen_at"), F.lit(False).alias("complete"))
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    days = F.sequence(*(F.date_trunc("day", F.lit(x).cast("timestamp")) for x in (lo, hi)), F.expr("interval 1 day"))
    passes = events.select(F.col("event_type").alias("source_key")).distinct().select("source_key", F.lit(None).cast("string").alias("external_id"), F.explode(days).alias("seen_at")).withColumn("complete", F.day("seen_at") % 3 != 0)
    found = streamed(seen.unionByName(passes), "seen_at", {"source_key": TICK, "external_id": TICK}, lambda s, late: state.absences(s, late))
    return found.where((F.col("status") == "nieaktywna") & (F.col("source_key") != TICK)).select("source_key", "external_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.col("at").cast("timestamp_ntz").alias("removed"))


@query("rate_limit_stream", "select event_id, recent, recent > 3 as refused from (select event_id, count(*) over (partition by user_id order by ts range between interval 24 hour preceding and current row) as recent from events)")
def _(spark, sf_dir):
    """The sliding limit of ``rate_limit_window``, decided on a stream."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = streamed(events, "ts", {"event_id": -1, "user_id": -1}, lambda s, late: state.rate_limits(s, late, 3, 86_400))
    return found.where("user_id <> -1").select("event_id", "recent", "refused")
