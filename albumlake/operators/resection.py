"""Where a photo was taken, from three landmarks in it whose places are known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, normalize_deg

LEAST_GAP_DEG, MOST_RMS_DEG, NEAREST_M = 0.5, 5.0, 0.5
M_PER_DEG = pi / 180 * EARTH_M


def turn_sum(values: list[Column], of: Callable[[Column], Column]) -> Column:
    return reduce(lambda a, b: a + b, [of(v) for v in values])


def photo_resection(landmarks: DataFrame, width: float, fov_deg: float) -> DataFrame:
    """photo_id, lat, lon, heading, rms of landmarks (photo_id, ord, lat, lon, pixel_x): a row a photo, nulls where three
    landmarks fix no place.

    On a plane about the first landmark A, whoever sees two points under an angle stands on one of two circles through
    them. A circle through A and B and one through B and C meet in B, and once more in B's mirror image across the line of
    their centres: four candidates, by the sides of the two circles. The one whose bearings fit best (least RMS) counts, if
    it fits within 5 degrees; angles under half a degree are too small. Further landmarks are not used.
    """
    if width <= 0 or not 0 < fov_deg < 180:
        raise ValueError("the width must be positive, the field of view between 0 and 180 degrees")
    three = landmarks.groupBy("photo_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "lat", "lon", "pixel_x"))), 1, 3).alias("p"))
    at = [F.get("p", F.lit(i)) for i in range(3)]
    m_lon = M_PER_DEG * F.cos(F.radians(at[0]["lat"]))
    cols = {"lat0": at[0]["lat"], "lon0": at[0]["lon"], "m_lon": m_lon}
    for i, p in enumerate(at):
        cols |= {f"x{i}": (p["lon"] - at[0]["lon"]) * m_lon, f"y{i}": (p["lat"] - at[0]["lat"]) * M_PER_DEG, f"a{i}": (p["pixel_x"] / width - 0.5) * fov_deg}
    d = three.select("photo_id", *[c.alias(k) for k, c in cols.items()])
    sides = [F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(k).alias("k")) for k, (s, t) in enumerate(((1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)))]
    d = d.withColumn("side", F.explode(F.array(*sides)))

    def centre(i: int, j: int, side: Column) -> dict[str, Column]:
        """The circle's centre lies off the chord's middle by half the chord over tan(angle)."""
        dx, dy, angle = F.col(f"x{j}") - F.col(f"x{i}"), F.col(f"y{j}") - F.col(f"y{i}"), F.radians(F.abs(F.col(f"a{j}") - F.col(f"a{i}")))
        off = F.when(F.col(f"gap{i}"), side / (2 * F.tan(angle)))
        return {f"cx{i}": (F.col(f"x{i}") + F.col(f"x{j}")) / 2 - dy * off, f"cy{i}": (F.col(f"y{i}") + F.col(f"y{j}")) / 2 + dx * off, f"chord{i}": F.hypot(dx, dy)}

    # No filters on the way: Spark would push them below all projections and spell out every expression in them.
    d = d.withColumns({f"gap{i}": F.abs(F.col(f"a{i + 1}") - F.col(f"a{i}")) >= LEAST_GAP_DEG for i in (0, 1)})
    d = d.withColumns(centre(0, 1, F.col("side.s")) | centre(1, 2, F.col("side.t")))
    d = d.withColumns({"ux": F.col("cx1") - F.col("cx0"), "uy": F.col("cy1") - F.col("cy0")}).withColumn("far", F.hypot("ux", "uy"))
    # The foot of B on the line of centres; the camera lies as far beyond it.
    along = ((F.col("x1") - F.col("cx0")) * F.col("ux") + (F.col("y1") - F.col("cy0")) * F.col("uy")) / (F.col("far") * F.col("far"))
    d = d.withColumn("along", F.when((F.col("chord0") >= 1e-6) & (F.col("chord1") >= 1e-6) & (F.col("far") >= 1e-9), along))
    d = d.withColumns({"px": 2 * (F.col("cx0") + F.col("along") * F.col("ux")) - F.col("x1"), "py": 2 * (F.col("cy0") + F.col("along") * F.col("uy")) - F.col("y1")})
    east, north = ([F.col(f"{c}{i}") - F.col(f"p{c}") for i in range(3)] for c in "xy")
    d = d.withColumns({f"b{i}": F.degrees(F.atan2(e, n)) for i, (e, n) in enumerate(zip(east, north, strict=True))} | {"nearest": F.least(*[F.hypot(e, n) for e, n in zip(east, north, strict=True)])})
    turn = [F.radians(F.col(f"b{i}") - F.col(f"a{i}")) for i in range(3)]
    d = d.withColumn("heading", normalize_deg(F.degrees(F.atan2(turn_sum(turn, F.sin), turn_sum(turn, F.cos)))))
    off = [normalize_deg(F.col("heading") + F.col(f"a{i}") - F.col(f"b{i}") + 180) - 180 for i in range(3)]
    d = d.withColumn("rms", F.sqrt(turn_sum(off, lambda o: o * o) / 3))
    place = F.struct("rms", "side.k", (F.col("lat0") + F.col("py") / M_PER_DEG).alias("lat"), (F.col("lon0") + F.try_divide("px", "m_lon")).alias("lon"), "heading")
    best = d.groupBy("photo_id").agg(F.min(F.when((F.col("nearest") >= NEAREST_M) & (F.col("rms") <= MOST_RMS_DEG), place)).alias("b"))
    return three.select("photo_id").join(best, "photo_id", "left").select("photo_id", "b.lat", "b.lon", "b.heading", "b.rms")
