"""Times: parsing, zones with the gaps and overlaps of daylight saving, and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ZONED = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"
BUCKETS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def localise(naive: Column, zone: str) -> Column:
    """The UTC time of local `naive` (timestamp_ntz): times that a forward shift skips move to its end, ambiguous ones are null.

    A time is skipped if it doesn't survive the way to UTC and back, and
    ambiguous if the offsets of a day before and a day after both bring it back.
    """
    local = naive.cast("timestamp_ntz")
    back = lambda utc: F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    there = lambda x: F.convert_timezone(F.lit(zone), F.lit("UTC"), x)
    day = F.expr("INTERVAL 1 DAY")
    # the time in UTC by the offset in force a day earlier and a day later
    early = local + (there(local - day) - (local - day))
    late = local + (there(local + day) - (local + day))
    early_fits, late_fits = back(early) == local, back(late) == local
    micros = lambda x: F.unix_micros(x.cast("timestamp"))  # noqa: E731  the session's zone is UTC
    # skipped: by the earlier offset a time lands as far behind the gap's end as it lies behind its start, and
    # gaps end at multiples of their width
    landed = micros(back(early))
    gap = landed - micros(local)
    end = F.timestamp_micros(micros(late) + gap - F.pmod(landed, F.nullif(gap, F.lit(0))))
    fitting = F.when(early == late, early).when(early_fits & late_fits, F.lit(None)).when(early_fits, early).when(late_fits, late)
    return F.when((early == late) | early_fits | late_fits, fitting.cast("timestamp")).otherwise(end)


def to_utc(c: Column, kind: T.DataType, zone: str | None = None) -> Column:
    """A timestamp from times or mixed text; numbers are null. Needs the session's zone to be UTC.

    Text with an offset or Z is taken as it says; other text and plain times
    are local to `zone`, or UTC without one.
    """
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        ntz = c.cast("timestamp_ntz")
        return localise(ntz, zone) if zone else ntz.cast("timestamp")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp")
    t = F.trim(c)
    dated = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    zoned = F.when(dated & t.rlike(_ZONED), t.try_cast("timestamp"))
    naive = F.when(dated & ~t.rlike(_ZONED), t.try_cast("timestamp_ntz"))
    return F.coalesce(zoned, localise(naive, zone) if zone else naive.cast("timestamp"))


def bucket(ts: Column, kind: str) -> tuple[Column, Column]:
    """Start and end of the UTC hour, day or week (from Monday) of a timestamp."""
    start = F.date_trunc(kind, ts)
    return start, start + F.expr(f"INTERVAL {BUCKETS[kind]}")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def local_hour(c: Column, zone: str) -> Column:
    """The hour of a UTC time on the clocks of a zone; null stays null."""
    return F.hour(F.from_utc_timestamp(c, zone))
