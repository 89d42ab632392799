"""Sun and moon over a place, as column expressions: the Astronomical Almanac's low-precision series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import normalize_deg

# Amplitude, phase and rate per century, in degrees, of the moon's longitude and latitude.
MOON_LONGITUDE = [(6.29, 134.9, 477198.85), (-1.27, 259.2, -413335.38), (0.66, 235.7, 890534.23), (0.21, 269.9, 954397.70), (-0.19, 357.5, 35999.05), (-0.11, 186.6, 966404.05)]
MOON_LATITUDE = [(5.13, 93.3, 483202.03), (0.28, 228.2, 960400.87), (-0.28, 318.3, 6003.18), (-0.17, 217.6, -407332.20)]
# The least altitude of the sun of each class.
TWILIGHT = [("Daylight", 6), ("Golden", 0), ("Blue", -6), ("Nautical", -12), ("Astronomical", -18)]
J2000_UNIX = 946728000


def days_since_2000(utc: Column) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ read as UTC, as days since noon of 1 January 2000."""
    return (F.timestamp_diff("SECOND", F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"), F.date_trunc("second", utc).cast("timestamp_ntz"))) / F.lit(86400.0)


def _sum(series: list[tuple[float, float, float]], days: Column) -> Column:
    waves = [F.lit(size) * F.sin(F.radians(normalize_deg(F.lit(phase) + F.lit(rate) * days / 36525.0))) for size, phase, rate in series]
    out = waves[0]
    for wave in waves[1:]:
        out = out + wave
    return out


def _horizontal(days: Column, lon_ecl: Column, lat_ecl: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(azimuth from north, altitude) in degrees of an ecliptic place in radians."""
    tilt = F.radians(F.lit(23.439) - F.lit(0.0000004) * days)
    dec = F.asin(F.sin(lat_ecl) * F.cos(tilt) + F.cos(lat_ecl) * F.sin(tilt) * F.sin(lon_ecl))
    ascension = F.atan2(F.sin(lon_ecl) * F.cos(tilt) - F.tan(lat_ecl) * F.sin(tilt), F.cos(lon_ecl))
    century = days / 36525.0
    sidereal = F.lit(280.46061837) + F.lit(360.98564736629) * days + century * century * (F.lit(0.000387933) - century / 38710000.0)
    hour = F.radians(normalize_deg(sidereal + lon)) - ascension
    up = F.sin(F.radians(lat)) * F.sin(dec) + F.cos(F.radians(lat)) * F.cos(dec) * F.cos(hour)
    south = F.atan2(F.sin(hour), F.cos(hour) * F.sin(F.radians(lat)) - F.tan(dec) * F.cos(F.radians(lat)))
    return normalize_deg(F.degrees(south) + 180.0), F.degrees(F.asin(F.least(F.greatest(up, F.lit(-1.0)), F.lit(1.0))))


def sun_position(utc: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    days = days_since_2000(utc)
    anomaly = F.radians(normalize_deg(F.lit(357.528) + F.lit(0.9856003) * days))
    along = F.radians(normalize_deg(F.lit(280.460) + F.lit(0.9856474) * days) + F.lit(1.915) * F.sin(anomaly) + F.lit(0.020) * F.sin(2 * anomaly))
    return _horizontal(days, along, F.lit(0.0), lat, lon)


def moon_position(utc: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    days = days_since_2000(utc)
    along = F.radians(F.lit(218.32) + F.lit(481267.8813) * days / 36525.0 + _sum(MOON_LONGITUDE, days))
    return _horizontal(days, along, F.radians(_sum(MOON_LATITUDE, days)), lat, lon)


def twilight(sun_altitude: Column) -> Column:
    out = F.when(sun_altitude > TWILIGHT[0][1], TWILIGHT[0][0])
    for name, least in TWILIGHT[1:]:
        out = out.when(sun_altitude > least, name)
    return F.when(sun_altitude.isNotNull(), out.otherwise("Night"))
