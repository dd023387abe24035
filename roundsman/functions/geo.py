"""Column builders for distances, durations and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: sphere radius in metres.
EARTH_RADIUS_M = 6371000.0


def js_round(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS_M)


def format_duration(seconds: Column) -> Column:
    """``N min``, ``H h`` or ``H h M``; a dash when the duration is not finite."""
    minutes = js_round(seconds / 60).cast("bigint")
    hours, rest = F.floor(minutes / 60).cast("bigint"), minutes % 60
    unknown = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf"))
    return (
        F.when(unknown, F.lit("—"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string")))
    )


def parse_lat_lon(text: Column) -> Column:
    """``"lat, lon"`` to struct(lat, lon); null unless two in-range numbers lead the two parts."""
    number = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    parts = F.split(F.coalesce(text, F.lit("")), ",", -1)
    lat, lon = (F.regexp_extract(F.get(parts, i), number, 1).try_cast("double") for i in (0, 1))
    usable = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(usable, F.struct(lat.alias("lat"), lon.alias("lon")))


def minutes_remaining(eta: Column, now: Column) -> Column:
    """Whole minutes until ``eta``, never negative."""
    millis = (F.unix_micros(eta.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1000
    return F.greatest(F.lit(0).cast("bigint"), js_round(millis / 60000).cast("bigint"))


def confidence_pct(score: Column) -> Column:
    return F.least(F.lit(100).cast("bigint"), js_round(score * 100).cast("bigint"))
