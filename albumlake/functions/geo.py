"""Geographic column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the IUGG.
EARTH_M = 6_371_008.8


def is_valid_gps(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing of the great circle, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return normalize_deg(F.degrees(turn))


def normalize_deg(x: Column) -> Column:
    return F.pmod(x.cast("double"), F.lit(360.0))


def destination_point(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """The point at a bearing and distance; longitude within 180 degrees either way."""
    a, t, d = F.radians(lat), F.radians(bearing), metres / EARTH_M
    to = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.pmod(lon + F.degrees(turn) + 180.0, F.lit(360.0)) - 180.0


def dms_format(degrees: Column, positive: str, negative: str) -> Column:
    """'deg,min.minutesH': 52.5 with N and S is 52,30.000000N."""
    micro = F.round(F.abs(degrees) * 60_000_000).cast("long")
    minutes = micro % 60_000_000
    return F.concat(
        F.floor(micro / 60_000_000).cast("string"), F.lit(","), F.floor(minutes / 1_000_000).cast("string"), F.lit("."),
        F.lpad((minutes % 1_000_000).cast("string"), 6, "0"), F.when(degrees < 0, negative).otherwise(positive),
    )


def dms_parse(text: Column) -> Column:
    """Signed degrees of dms_format's grammar; null where it does not fit."""
    grammar = r"^(\d{1,3}),(\d{1,2}(?:\.\d+)?)([NSEW])$"
    deg, minutes, side = (F.regexp_extract(text, grammar, i) for i in (1, 2, 3))
    sign = F.when(side.isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(side != "", sign * (F.expr("0D") + deg.try_cast("double") + minutes.try_cast("double") / 60))
