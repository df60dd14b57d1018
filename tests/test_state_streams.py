"""Keyed state on streams: absence, limits, prices; each against a plain version over all rows, however cut into batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kadastra import constants as C
from kadastra.operators.search import Filters
from kadastra.streaming import jobs, state

START = dt.datetime(2026, 1, 1)


def hours(x):
    return START + dt.timedelta(hours=x)


def stream(spark, tmp_path, batches, schema, make, name):
    """Rows that ``make`` gives when the batches come one after the other, the stream stopped and started again between them."""
    state.use_state(spark)
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / "in"))
        made = make(spark.readStream.schema(schema).json(str(folder / "in")))
        run = made.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(120), k
    return spark.read.schema(made.schema).parquet(str(folder / "out")).collect()


SEEN = "source_key string, external_id string, seen_at timestamp, complete boolean"


def gone(rows, days=C.MISSING_DAYS):
    """(source, offer, last seen, pass) of all that turns inactive, by walking through the rows in their order."""
    out, active = [], {}
    for source, offer, at, complete in sorted(rows, key=lambda r: (r[2], r[1] is None)):
        if offer is not None:
            active[source, offer] = at
        elif complete:
            for key in [k for k, last in active.items() if k[0] == source and last < at - dt.timedelta(days=days)]:
                out.append((*key, active.pop(key), at))
    return sorted(out)


def _taken_down(found):
    return sorted((r.source_key, r.external_id, r.last_seen, r.at) for r in found if r.status == "nieaktywna")


END = [("end", "end", hours(9000), False), ("end", "end", hours(18000), False)]


def test_absent_after_a_complete_pass_only(spark, tmp_path):
    rows = [("a", "1", hours(0), None), ("a", "2", hours(0), None), ("b", "1", hours(0), None), ("a", "2", hours(90), None), ("a", None, hours(95), False), ("a", None, hours(100), True), ("a", "1", hours(150), None)]
    found = stream(spark, tmp_path, [rows, END[:1], END[1:]], SEEN, lambda s: state.absences(s, parts=4), "one")
    assert _taken_down(found) == [("a", "1", hours(0), hours(100))]  # b had no pass, the broken pass of a took nothing down
    told = [r.status for r in sorted((r for r in found if (r.source_key, r.external_id) == ("a", "1")), key=lambda r: r.at)]
    assert told == ["aktywna", "nieaktywna", "aktywna"]


@pytest.mark.parametrize("cut", [1, 3])
def test_absence_equals_a_walk_through_all_rows(spark, tmp_path, cut):
    r = random.Random(cut)
    rows = [(r.choice("ab"), str(r.randrange(12)), hours(r.randrange(900)), r.choice([None, False, True])) for _ in range(260)]
    rows += [(r.choice("ab"), None, hours(r.randrange(900)), r.random() < 0.6) for _ in range(25)] + [(None, "1", hours(5), False), ("a", None, hours(7), None)]
    late = [x[2] + dt.timedelta(hours=r.randrange(40)) for x in rows]  # rows come up to 40 hours late
    order = [x for _, x in sorted(zip(late, rows, strict=True), key=lambda p: p[0])]
    size = -(-len(order) // cut)
    batches = [order[k : k + size] for k in range(0, len(order), size)]
    found = stream(spark, tmp_path, [*batches, END[:1], END[1:]], SEEN, lambda s: state.absences(s, "48 hours", parts=3), f"cut{cut}")
    assert _taken_down(found) == gone([x for x in rows if x[0]])


EVENT = "event_id long, ts timestamp, user_id long"


def test_limits_equal_the_window_over_the_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, START + dt.timedelta(seconds=r.choice([1, 1, 1, 20]) * r.randrange(2000)), r.choice([1, 1, 1, 2, 3])) for i in range(500)]
    order = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=r.randrange(500)), x[0]))  # up to 500 seconds late
    batches = [order[k : k + 250] for k in range(0, len(order), 250)] + [[(None, hours(900), 99)], [(None, hours(1800), 99)]]
    found = stream(spark, tmp_path, batches, EVENT, lambda s: state.rate_limits(s, "10 minutes", 20, 3600), "limits")
    want = jobs.rate_limited(spark.createDataFrame(rows, EVENT), 20, 3600).collect()
    assert sorted((x.event_id, x.ts, x.user_id, x.recent, x.refused) for x in found if x.user_id != 99) == sorted((x.event_id, x.ts, x.user_id, x.recent, x.refused) for x in want)
    assert any(x.refused for x in want) and not all(x.refused for x in want)


PRICE = "listing_id long, ts timestamp, price double"


def test_price_changes_across_batches(spark, tmp_path):
    rows = [(1, hours(1), 10.0), (1, hours(2), 10.2), (1, hours(3), 12.0), (1, hours(4), None), (2, hours(1), 5.0), (None, hours(1), 7.0)]
    later = [(1, hours(5), 12.3), (1, hours(6), 9.0), (2, hours(4), 5.4)]
    much_later = [[(3, hours(2000), 1.0)], [(1, hours(2001), 9.2), (2, hours(2001), 5.5)]]  # by then 1 and 2 are forgotten
    found = stream(spark, tmp_path, [rows, later, *much_later], PRICE, lambda s: state.price_changes(s, "10 hours", 30), "prices")
    assert sorted((r.listing_id, r.price, r.previous) for r in found if r.previous) == [(1, 9.0, 12.0), (1, 12.0, 10.0)]
    assert sorted((r.listing_id, r.price) for r in found if r.previous is None) == [(1, 9.2), (1, 10.0), (2, 5.0), (2, 5.5), (3, 1.0)]


def test_alerts_of_an_earlier_run_are_not_told_again(spark, tmp_path):
    kinds = "id long, price double, listed_at timestamp, is_original boolean, status string"
    row = lambda i: (i, 1.0, dt.datetime(2026, 1, 1), True, "aktywna")
    told, channels = [], spark.createDataFrame([(1, "mail")], "search_id int, channel string")
    for run, ids in (("first", [1]), ("second", [1, 2]), ("second", [1, 2])):  # the last is a replay
        sink = jobs.alert_sink(spark, str(tmp_path / "log"), {1: Filters()}, channels, lambda: "2026-01-02 00:00:00", lambda d: told.append(sorted(r.id for r in d.collect())), run)
        sink(spark.createDataFrame([row(i) for i in ids], kinds), 0)
    assert told == [[1], [2], [2]]
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.count("*")).first()[0] == 2


class Handle:
    """Timers and one value, as a processor of one user sees them; all calls are counted."""

    def __init__(self):
        self.timers, self.value, self.calls = set(), None, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):
        self.timers.discard(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value = None


def test_a_limit_has_one_timer_for_all_buckets_that_are_over():
    """Two thousand events of a user over a month: a few calls for each batch, not some for each bucket of time."""
    import numpy as np
    import pandas as pd

    r = random.Random(6)
    times = np.array(sorted(r.randrange(30 * 86_400 * 10**6) for _ in range(2000)), np.int64)
    handle, limit, got = Handle(), state._Limit(3, 86_400, 12), {}
    limit.init(handle)
    for k in range(4):
        part = slice(500 * k, 500 * (k + 1))
        mark = int(times[part].max()) // 1000
        list(limit.handleInputRows((1,), iter([pd.DataFrame({"ts": pd.to_datetime(times[part], unit="us"), "event_id": np.arange(2000)[part]})]), None))
        for now in (mark, mark + 10**12) if k == 3 else (mark,):
            while due := sorted(t for t in handle.timers if t <= now):
                handle.timers.discard(due[0])
                clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, now=now: now, "getExpiryTimeInMs": lambda self, due=due: due[0]})()
                for f in limit.handleExpiredTimer((1,), clock, clock):
                    got |= dict(zip(f["event_id"].tolist(), f["recent"].tolist(), strict=True))
    assert got == {i: int(np.sum((times <= t) & (times >= t - 86_400 * 10**6))) for i, t in enumerate(times.tolist())}
    assert handle.value is None and not handle.timers and handle.calls < 40
