"""Zones and ISO 8601 as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_local(c: Column | str, zone: str) -> Column:
    """The wall clock of a zone at UTC times (both without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def to_utc(c: Column | str, zone: str) -> Column:
    """The UTC time of wall clock times of a zone (both without zone)."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def offset_at(c: Column | str, zone: str) -> Column:
    """Seconds by which the zone is ahead of UTC at UTC times."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", c, to_local(c, zone)).cast("int")


def iso_timestamp(c: Column | str) -> Column:
    """ISO 8601 text of times without zone, with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso_timestamp(c: Column | str) -> Column:
    """Time without zone of ISO 8601 text; null where it is none."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def parse_iso_duration(c: Column | str) -> Column:
    """Seconds (double) of ISO 8601 durations of weeks, days, hours, minutes and seconds; null where the text is none."""
    c = F.col(c) if isinstance(c, str) else c
    whole = r"^([+-])?P(?=\d|T\d)(?:(\d+)W)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda g: F.coalesce(F.nullif(F.regexp_extract(c, whole, g), F.lit("")).cast("double"), F.lit(0.0))
    total = part(2) * 604800 + part(3) * 86400 + part(4) * 3600 + part(5) * 60 + part(6)
    return F.when(c.rlike(whole), F.when(F.regexp_extract(c, whole, 1) == "-", -total).otherwise(total))
