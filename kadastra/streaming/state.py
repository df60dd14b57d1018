"""Keyed state on streams: offers that stay away, rate limits, price changes that are forgotten after a while.

All run on ``transformWithState``, whose state lies in RocksDB beside the checkpoint. Absence and limits are decided by
event-time timers, when the watermark has passed the moment that they are about: so late rows within the watermark's delay
count, and a replay of the same rows, however cut into batches, decides the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kadastra import constants as C

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Parts that the offers of one source are dealt to, so that no task holds a large source alone.
PARTS = 32
#: Time buckets in a limit's window: a decision waits for the end of its bucket.
RING = 12


def use_state(spark: SparkSession) -> None:
    """Session settings that keyed state needs; to be called before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ms]").astype(np.int64)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


class _Absence(StatefulProcessor):
    """Of one part of a source: for each active offer the times at which it was seen that a pass may still ask for."""

    def __init__(self, away_ms: int):
        self.away = away_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offers = handle.getMapState("offers", "external_id string", "seen array<bigint>")

    def _rows(self, key, out) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["external_id", "last_seen", "at", "status"])
        found.insert(0, "source_key", key[0])
        for c in ("last_seen", "at"):
            found[c] = pd.to_datetime(found[c], unit="ms")
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(rows)
        for at in np.unique(_millis(told["seen_at"][told["complete"]])).tolist():
            self.handle.registerTimer(at)
        seen, out = told[~told["complete"]], []
        for offer, times in pd.Series(_millis(seen["seen_at"]), index=seen["external_id"].to_numpy(object)).groupby(level=0):
            times = np.unique(times).tolist()
            if self.offers.containsKey((offer,)):
                times = sorted({*self.offers.getValue((offer,))[0], *times})
            else:
                out.append((offer, times[0], times[0], "aktywna"))
            self.offers.updateValue((offer,), (times,))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out, kept = expiredTimerInfo.getExpiryTimeInMs(), [], {}
        for (offer,), (seen,) in self.offers.iterator():
            before, after = [t for t in seen if t <= at], [t for t in seen if t > at]
            if before and before[-1] < at - self.away:
                out.append((offer, before[-1], at, "nieaktywna"))
                if after:  # came back since
                    out.append((offer, after[0], after[0], "aktywna"))
                kept[offer] = after
            elif len(before) > 1:  # earlier times are asked for no more
                kept[offer] = [before[-1], *after]
        for offer, times in kept.items():
            if times:
                self.offers.updateValue((offer,), (times,))
            else:
                self.offers.removeKey((offer,))
        if out:
            yield self._rows(key, out)


def absences(observations: DataFrame, late: str = "1 hour", days: float = C.MISSING_DAYS, parts: int = PARTS) -> DataFrame:
    """Changes of status of a stream of (source_key, external_id, seen_at, complete): source_key, external_id, last_seen, at, status.

    An offer turns active when it is first seen, and inactive at the end of a complete pass over its source (a row with
    ``complete`` true and no external_id, written when the pass has ended without an error) if it was last seen more than
    ``days`` before. A pass that broke off writes no such row, or one with false, and takes no offer down. An offer seen
    again turns active again. Rows without a source, or with neither an offer nor a complete pass, tell nothing.

    A pass is judged when the watermark has passed its end: rows up to ``late`` late are taken into account. What turns active
    is told at once, with the earliest time known by then. The offers of a source are dealt to ``parts`` keys, each of which is
    told of the source's passes; the state holds one row for each active offer, and those that went are forgotten.
    """
    one_part = F.array(F.pmod(F.xxhash64("external_id"), F.lit(parts)).cast("int"))
    every = F.when(F.col("complete"), F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = observations.select("source_key", F.col("external_id").cast("string").alias("external_id"), "seen_at", F.coalesce("complete", F.lit(False)).alias("complete")).where("source_key is not null")
    dealt = rows.withColumn("part", F.explode(F.when(F.col("external_id").isNotNull(), one_part).otherwise(every))).withColumn("complete", F.col("complete") & F.col("external_id").isNull())
    return (
        dealt.withWatermark("seen_at", late)
        .groupBy("source_key", "part")
        .transformWithStateInPandas(_Absence(int(days * DAY_MS)), "source_key string, external_id string, last_seen timestamp, at timestamp, status string", "append", "eventTime")
    )


class _Limit(StatefulProcessor):
    """Of one user: the events of the last window and those not yet decided, and one timer for the earliest bucket that is open."""

    def __init__(self, limit: int, seconds: int, ring: int):
        self.limit, self.window, self.step = limit, seconds * 1_000_000, -(-seconds * 1_000_000 // ring)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at binary, event binary, done bigint, timer bigint")  # times and events as arrays of longs; those before ``done`` are decided

    def _end(self, at):
        """Milliseconds by which the bucket of a time is over."""
        return -(-(at // self.step + 1) * self.step // 1000)

    def _state(self) -> tuple[np.ndarray, np.ndarray, int | None, int | None]:
        found = self.held.get() if self.held.exists() else None
        if found is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), None, None
        return np.frombuffer(bytes(found[0]), np.int64), np.frombuffer(bytes(found[1]), np.int64), found[2], found[3]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(rows)
        new = _micros(told["ts"])
        at, event, done, timer = self._state()
        due = int(self._end(new.min()))
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.held.update((np.concatenate([at, new]).tobytes(), np.concatenate([event, told["event_id"].to_numpy(np.int64)]).tobytes(), done, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        at, event, done, _ = self._state()
        over = (now * 1000 // self.step) * self.step  # buckets before are over
        fresh = (at < over) & (at >= done) if done is not None else at < over
        if fresh.any():
            near, mine = np.sort(at), at[fresh]
            recent = np.searchsorted(near, mine, "right") - np.searchsorted(near, mine - self.window, "left")
            yield pd.DataFrame({"user_id": key[0], "event_id": event[fresh], "ts": pd.to_datetime(mine, unit="us"), "recent": recent, "refused": recent > self.limit})
        open_ = at[at >= over]
        kept = at >= over - self.window  # no event that is open or to come asks for earlier ones
        if not kept.any():
            self.held.clear()
            return
        timer = int(self._end(open_.min())) if len(open_) else -(-(int(at.max()) + self.window + self.step + 1) // 1000)  # by then nobody asks for these
        self.handle.registerTimer(timer)
        self.held.update((at[kept].tobytes(), event[kept].tobytes(), over, timer))


def rate_limits(events: DataFrame, late: str = "10 minutes", limit: int = C.RATE_LIMIT, seconds: int = C.RATE_SECONDS, ring: int = RING) -> DataFrame:
    """user_id, event_id, ts, recent and refused for each event of a stream of (event_id, ts, user_id): how many events of its user
    lie in the ``seconds`` up to it, those of the same moment included, and whether these are more than ``limit``.

    Equals ``jobs.rate_limited`` over the same events as a table. An event is decided when the watermark has passed the end of
    its time bucket, a ``ring``-th of the window, so events up to ``late`` late count for others and are decided themselves.
    A user has one timer, at which all buckets that are over are decided together. The state holds a user's last window only. Events without a user or time are passed over.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").where("user_id is not null and ts is not null")
    made = "user_id long, event_id long, ts timestamp, recent long, refused boolean"
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(_Limit(limit, seconds, ring), made, "append", "eventTime")


class _Prices(StatefulProcessor):
    """Of one listing: the last price told, and when it is to be forgotten."""

    def __init__(self, keep_ms: int | None):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, until = self.last.get() if self.last.exists() else (None, 0)
        told = pd.concat(rows)
        told = told[told["price"].notna()].sort_values(["ts", "price"])
        if told.empty:
            return
        out, at, prices, i = [], told["ts"].to_numpy(), told["price"].to_numpy(float), 0
        while i < len(prices):  # from change to change
            if last is not None:
                moved = np.abs(prices[i:] - last) > C.PRICE_CHANGE
                if not moved.any():
                    break
                i += int(moved.argmax())
            out.append((key[0], at[i], prices[i], last))
            last, i = float(prices[i]), i + 1
        if self.keep is not None and (due := int(_millis(told["ts"])[-1]) + self.keep) > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(due)
            until = due
        self.last.update((last, until))
        yield pd.DataFrame(out, columns=["listing_id", "ts", "price", "previous"]).astype({"previous": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def price_changes(events: DataFrame, late: str = "1 hour", forget_days: float | None = C.RETENTION_DAYS) -> DataFrame:
    """Price changes of a stream of (listing_id, ts, price): listing_id, ts, price, previous. A price counts as changed if it
    differs from the last change by more than PRICE_CHANGE; the first one known has no previous.

    A listing whose last price is older than ``forget_days`` when the watermark passes (None: never) is forgotten, and its next
    price is a first one. Rows without a price or a listing tell nothing. Within a batch rows count in the order of their
    times, equal ones by price.
    """
    processor = _Prices(None if forget_days is None else int(forget_days * DAY_MS))
    made = "listing_id long, ts timestamp, price double, previous double"
    return events.where("listing_id is not null").withWatermark("ts", late).groupBy("listing_id").transformWithStateInPandas(processor, made, "append", "eventTime")
