"""Times in any form, ages, stages and slots. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper borders in hours. Fixed values.
STAGE_BORDERS = [(3.5, "1h"), (15.0, "6h"), (48.0, "24h")]
STAGE_HOURS = {"1h": 1, "6h": 6, "24h": 24, "72h": 72}
AGE_BORDERS = [(1.0, "<1h"), (6.0, "1-6h"), (24.0, "6-24h"), (72.0, "24-72h")]
SIZE_BORDERS = [(5_000, "<5k"), (25_000, "5-25k"), (100_000, "25-100k"), (500_000, "100-500k")]


def parse_any(c) -> Column:
    """A timestamp from seconds since 1970, ISO text with blank or T, with or without seconds and zone, or a date; null else."""
    text = F.trim(c.cast("string"))
    seconds = F.when(text.rlike(r"^-?[0-9]{9,11}(\.[0-9]+)?$"), text.try_cast("double"))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?$"), text)
    zoned = F.regexp_replace(F.regexp_replace(iso, r" (Z|[+-][0-9:]+)$", "$1"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.coalesce(F.timestamp_seconds(seconds), zoned.try_cast("timestamp"))


def hours_between(a, b) -> Column:
    """Hours from ``a`` to ``b``, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 3.6e9


def _by_border(c, borders, rest: str) -> Column:
    out = F
    for border, name in borders:
        out = out.when(c < border, name)
    return out.otherwise(rest)


def stage(age_hours) -> Column:
    """The stage nearest to an age; null for an unknown age."""
    return F.when(age_hours.isNotNull(), _by_border(age_hours, STAGE_BORDERS, "72h"))


def due_at(published, stage_) -> Column:
    hours = F.create_map(*(x for k, v in STAGE_HOURS.items() for x in (F.lit(k), F.lit(v))))[stage_]
    return F.timestamp_seconds(F.unix_timestamp(published.cast("timestamp")) + hours * 3600)


def age_bucket(age_hours) -> Column:
    """An unknown age counts as the oldest."""
    return F.when(age_hours.isNull(), ">72h").otherwise(_by_border(age_hours, AGE_BORDERS, ">72h"))


def size_class(size) -> Column:
    """Null for an unknown or non-positive size."""
    return F.when(size > 0, _by_border(size, SIZE_BORDERS, ">500k"))


def id_time(c, epoch_ms: int = 1_288_834_974_657) -> Column:
    """The time inside a 64-bit id: milliseconds above the lower 22 bits."""
    return F.timestamp_millis(F.shiftright(c.cast("long"), 22) + epoch_ms)


def iso_duration(c) -> Column:
    """Seconds of P#DT#H#M#S; null for anything else."""
    shape = r"^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    text = F.trim(c)
    part = lambda i: F.coalesce(F.regexp_extract(text, shape, i).try_cast("long"), F.lit(0))
    return F.when(text.rlike(shape), part(1) * 86_400 + part(2) * 3_600 + part(3) * 60 + part(4))


def day_in_zone(c, zone: str) -> Column:
    """Calendar day of a UTC time in a zone, such as that of a quota."""
    return F.to_date(F.from_utc_timestamp(c.cast("timestamp"), zone))


def valid_time(c) -> Column:
    """Not null, and not the year 1970 that stands for unknown."""
    return c.isNotNull() & (F.year(c) != 1970)


def expected_slots(published, now, dense_hours: int = 6, step_hours: int = 12) -> Column:
    """Times at which a post should have been measured: every hour for the first hours, then every ``step_hours``."""
    start, end = F.unix_timestamp(published.cast("timestamp")), F.unix_timestamp(now.cast("timestamp"))
    hours = F.floor((end - start) / 3600).cast("int")
    dense = F.sequence(F.lit(0), F.least(hours, F.lit(dense_hours)))
    later = F.when(hours >= step_hours, F.sequence(F.lit(step_hours), hours, F.lit(step_hours))).otherwise(F.array().cast("array<int>"))
    return F.when(hours >= 0, F.transform(F.concat(dense, later), lambda h: F.timestamp_seconds(start + h * 3600))).otherwise(F.array().cast("array<timestamp>"))
