"""Dates and coordinates as files write them, read by column functions; null where they can't be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of a date, after those of documents and cameras, in the order in
#: which they are tried; of numbers alone the month comes first, unless it can't be one.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd",
    "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
    "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss",
)
_DOCUMENT = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?"
_CAMERA = r"^(\d{4}):(\d{1,2}):(\d{1,2})(?:\s+(\d{1,2}):(\d{1,2}):(\d{1,2}))?"
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_ZONE = r"\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"


def _parts(text: Column, pattern: str) -> Column:
    """The timestamp of the six groups of a pattern; those of the time are 0 where they are missing."""
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    day = [part(i) for i in (1, 2, 3)]
    time = [F.coalesce(part(i), F.lit(0)) for i in (4, 5, 6)]
    written = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *day, *time)
    return F.when(text.rlike(pattern), F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_date(text: Column) -> Column:
    """The timestamp that a text states, without its zone: as documents write it
    (``D:20240131120000``), as cameras do (``2024:01:31 12:00:00``), or in one of ``FORMATS``."""
    own = F.trim(text)
    plain = F.when(own.rlike(r"\d{2}:\d{2}.*" + _ZONE), F.regexp_replace(own, _ZONE, "")).otherwise(own)
    plain = F.regexp_replace(plain, _WEEKDAY, "")
    tried = [F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS]
    return F.coalesce(_parts(own, _DOCUMENT), _parts(own, _CAMERA), *tried)


_DECIMAL = r"([-+]?\d{1,3}\.\d+)[\s,]+([-+]?\d{1,3}\.\d+)"
_CARDINAL = r"(?i)(\d{1,3}\.\d+)°?\s?([NS])[\s,]+(\d{1,3}\.\d+)°?\s?([EW])"
_MINUTES = r"(?i)(\d{1,3})°(\d{1,2})'([\d.]+)\"?([NS])[\s,]+(\d{1,3})°(\d{1,2})'([\d.]+)\"?([EW])"


def parse_coordinates(text: Column) -> Column:
    """Latitude and longitude as a struct (lat, lon), from decimals, decimals with directions, or
    degrees, minutes and seconds; null where a text has none, or none on earth."""
    got = lambda pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda pattern, i: got(pattern, i).try_cast("double")
    signed = lambda value, side: F.when(F.upper(side).isin("S", "W"), -value).otherwise(value)
    angle = lambda i: number(_MINUTES, i) + number(_MINUTES, i + 1) / 60 + number(_MINUTES, i + 2) / 3600
    pair = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    found = (
        F.when(text.rlike(_DECIMAL), pair(number(_DECIMAL, 1), number(_DECIMAL, 2)))
        .when(text.rlike(_CARDINAL), pair(signed(number(_CARDINAL, 1), got(_CARDINAL, 2)), signed(number(_CARDINAL, 3), got(_CARDINAL, 4))))
        .when(text.rlike(_MINUTES), pair(signed(angle(1), got(_MINUTES, 4)), signed(angle(5), got(_MINUTES, 8))))
    )
    return F.when((F.abs(found["lat"]) <= 90) & (F.abs(found["lon"]) <= 180), found)
