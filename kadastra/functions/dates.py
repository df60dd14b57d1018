"""Dates as Spark columns: UTC instants and Warsaw wall-clock times, both without zone (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kadastra import constants as C


def to_utc(local: Column) -> Column:
    """Warsaw wall clock to UTC."""
    return F.to_utc_timestamp(local.cast("timestamp"), C.WARSAW).cast("timestamp_ntz")


def to_warsaw(utc: Column) -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp"), C.WARSAW).cast("timestamp_ntz")


def warsaw_midnight_utc(utc: Column) -> Column:
    """The instant at which the Warsaw day of an instant began."""
    return to_utc(F.date_trunc("DAY", to_warsaw(utc).cast("timestamp")))


def _month(word: Column) -> Column:
    pairs = [x for k, v in C.MONTHS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def parse_moment(text: Column, now: Column, naive_local: bool = False) -> Column:
    """A moment in UTC: ISO (with or without zone), unix seconds or milliseconds, dd.mm.yyyy, Polish month names,
    today and yesterday; null for what is none of these. With ``naive_local``, times without zone are Warsaw's."""
    t = F.trim(F.lower(text))
    as_is = to_utc if naive_local else (lambda x: x.cast("timestamp_ntz"))
    zoned = F.when(t.rlike(r"^\d{4}-\d\d-\d\dt\d\d:\d\d(:\d\d(\.\d+)?)?(z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.upper(t)).cast("timestamp_ntz"))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([ t]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"), as_is(F.try_to_timestamp(F.translate(t, "t", " "))))
    number = F.when(t.rlike(r"^\d{9,13}$"), t.cast("double"))
    unix = F.when(number.isNotNull(), F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number)).cast("timestamp_ntz"))
    dotted = r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?:\D+(\d{1,2}):(\d\d))?"
    worded = r"(?U)(\d{1,2})\s+(\p{L}+)\.?(?:\s+(\d{4}))?(?:\D+(\d{1,2}):(\d\d))?"

    def built(pattern: str, month: Column, year: Column) -> Column:
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, pattern, k), F.lit("")), F.lit("0"))
        joined = F.format_string("%04d-%02d-%02d %02d:%02d:00", year, month, part(1).cast("int"), part(4).cast("int"), part(5).cast("int"))
        return F.when(t.rlike(pattern) & month.isNotNull(), as_is(F.try_to_timestamp(joined)))

    by_dots = built(dotted, F.nullif(F.regexp_extract(t, dotted, 2), F.lit("")).cast("int"), F.nullif(F.regexp_extract(t, dotted, 3), F.lit("")).cast("int"))
    own_year = F.nullif(F.regexp_extract(t, worded, 3), F.lit("")).cast("int")
    by_words = built(worded, _month(F.regexp_extract(t, worded, 2)), F.coalesce(own_year, F.year(now)))
    today = F.when(t.rlike("dzisiaj|dziś|today"), F.date_trunc("DAY", now.cast("timestamp")).cast("timestamp_ntz")).when(t.rlike("wczoraj"), (F.date_trunc("DAY", now.cast("timestamp")) - F.expr("interval 1 day")).cast("timestamp_ntz"))
    return F.coalesce(zoned, iso, unix, today, by_dots, by_words)


def not_in_future(moment: Column, now: Column) -> Column:
    return F.when(moment <= now + F.expr("interval 1 day"), moment)


def listed_at(published: Column, first_seen: Column) -> Column:
    """When an offer was put up: as the portal says, but not after we first saw it."""
    return F.when(published.isNull() | (published > first_seen), first_seen).otherwise(published)


def whole_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long"))


def concluded(kind: Column, event: Column, deadline: Column, now_warsaw: Column) -> Column:
    return kind.isin("licytacja", "przetarg") & F.coalesce(F.greatest(event, deadline) < now_warsaw - F.expr("interval 1 day"), F.lit(False))
