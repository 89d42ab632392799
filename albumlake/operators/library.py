"""Library operators over photos: filters, smart albums, histograms, bursts, geofences, as-of matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, is_valid_gps


def contains_ci(col: Column, needle: str) -> Column:
    return F.contains(F.lower(col), F.lit(needle.lower()))


def pick_state(rating: Column, state: str) -> Column:
    r = F.coalesce(rating, F.lit(0))
    return {"Any": F.lit(True), "Rejected": r == -1, "Picked": r >= 0, "Unflagged": r == 0}[state]


#: The place fields that text is looked for in.
PLACES = ["location", "city", "state", "country", "country_code"]


def clause(rule: dict, people: tuple[str, ...] = ("persons_shown",)) -> Column:
    """One smart-album clause as a predicate; blank text needles match everything. `people` are the arrays of names."""
    kind = rule["type"]
    if kind == "minRating":
        return F.coalesce(F.col("rating"), F.lit(0)) >= rule["value"]
    if kind == "keyword":
        needle = rule["value"]
        if not needle.strip():
            return F.lit(True)
        return F.exists("keywords", lambda k: F.contains(k, F.lit(needle)) if rule.get("caseSensitive") else contains_ci(k, needle))
    if kind == "person":
        if not rule["value"].strip():
            return F.lit(True)
        return reduce(Column.__or__, [F.coalesce(F.exists(c, lambda p: contains_ci(p, rule["value"])), F.lit(False)) for c in people])
    if kind == "location":
        places = F.array_compact(F.array(*PLACES))
        return F.exists(places, lambda p: contains_ci(p, rule["value"])) if rule["value"].strip() else F.lit(True)
    if kind == "colorLabel":
        return F.coalesce(F.lower("color_label") == rule["value"].lower(), F.lit(False))
    if kind == "pickState":
        return pick_state(F.col("rating"), rule["value"])
    if kind == "dateRange":
        ends = [F.col("captured") >= F.lit(rule["from"]).cast("timestamp_ntz")] if rule.get("from") else []
        ends += [F.col("captured") <= F.lit(rule["to"]).cast("timestamp_ntz")] if rule.get("to") else []
        return reduce(Column.__and__, ends, F.col("captured").isNotNull())
    if kind == "gpsBox":
        south, west, north, east = rule["value"]
        return is_valid_gps(F.col("lat"), F.col("lon")) & F.col("lat").between(south, north) & F.col("lon").between(west, east)
    raise ValueError(f"unknown clause {kind}")


def rule(clauses: list[dict], mode: str = "and", people: tuple[str, ...] = ("persons_shown",)) -> Column:
    """AND or OR over the clauses; a rule without clauses matches every photo."""
    if not clauses:
        return F.lit(True)
    return reduce(Column.__and__ if mode == "and" else Column.__or__, [clause(c, people) for c in clauses])


def _named(photos: DataFrame, regions: DataFrame | None, clauses: list[dict]) -> tuple[DataFrame, tuple[str, ...]]:
    """photos with the labels of their Person regions, if a clause asks for people; and the arrays to look in."""
    if regions is None or not any(c["type"] == "person" for c in clauses):
        return photos, ("persons_shown",)
    labels = regions.filter("category = 'Person'").groupBy("file_id").agg(F.collect_set("label").alias("_people"))
    return photos.join(labels, "file_id", "left"), ("_people", "persons_shown")


def smart_album(photos: DataFrame, clauses: list[dict], mode: str = "and", regions: DataFrame | None = None) -> DataFrame:
    """Photos that fit the rule. A person is one shown, or the label of a Person region of the photo."""
    rows, people = _named(photos, regions, clauses)
    return rows.filter(rule(clauses, mode, people)).select(*photos.columns)


def smart_albums_membership(photos: DataFrame, albums: dict[str, list[dict]], modes: dict[str, str] | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Photos per album, all rules in one pass; modes has the albums that are not AND."""
    photos, people = _named(photos, regions, [c for clauses in albums.values() for c in clauses])
    hits = F.array_compact(F.array(*[F.when(rule(c, (modes or {}).get(n, "and"), people), F.lit(n)) for n, c in albums.items()]))
    return photos.select(F.explode(hits).alias("album")).groupBy("album").agg(F.count("*").alias("n"))


def auto_granularity(photos: DataFrame) -> str:
    """Day for a span under a year, week under five, else month."""
    days = photos.agg(F.datediff(F.max("captured"), F.min("captured"))).first()[0]
    return "day" if days is None or days < 365 else "week" if days < 5 * 365 else "month"


def timeline_histogram(photos: DataFrame, granularity: str | None = None) -> DataFrame:
    """Dense counts per day, week or month bucket between the first and last photo; by default auto_granularity's."""
    granularity = granularity or auto_granularity(photos)
    counts = photos.filter("captured is not null").groupBy(F.date_trunc(granularity, "captured").cast("date").alias("bucket")).agg(F.count("*").alias("n"))
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[granularity]
    spine = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def person_timeline(photos: DataFrame) -> DataFrame:
    """Per person and year: photos, with the person's first and last date, by a two-level aggregate."""
    yearly = photos.groupBy("person", F.year("captured").alias("year")).agg(F.count("*").alias("n"), F.min("captured").alias("lo"), F.max("captured").alias("hi"))
    w = Window.partitionBy("person")
    return yearly.select("person", "year", "n", F.min("lo").over(w).cast("date").alias("first_seen"), F.max("hi").over(w).cast("date").alias("last_seen"))


def memories(photos: DataFrame, today: str) -> DataFrame:
    """A row per photo and window it falls in: file_id, time_window, key (year, or first year of the decade), years_ago.

    Day, Week (ISO) and Month take any year but the reference's, later ones too; Year the reference's only; Decade any
    other decade, counted from its middle.
    """
    day = F.lit(today).cast("date")
    d = F.col("captured").cast("date")
    year, ref = F.year(d), F.year(day)
    other = year != ref
    decade = (F.floor(year / 10) * 10).cast("int")

    def hit(name: str, cond: Column, key: Column, ago: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("time_window"), key.alias("key"), ago.alias("years_ago")))

    month = other & (F.month(d) == F.month(day))
    hits = F.array_compact(F.array(
        hit("Day", month & (F.dayofmonth(d) == F.dayofmonth(day)), year, ref - year),
        hit("Week", other & (F.weekofyear(d) == F.weekofyear(day)), year, ref - year),
        hit("Month", month, year, ref - year),
        hit("Year", ~other, year, ref - year),
        hit("Decade", decade != F.floor(ref / 10) * 10, decade, ref - (decade + 5)),
    ))
    return photos.select("file_id", F.inline(hits))


def geo_grid_cluster(photos: DataFrame, degrees: float) -> DataFrame:
    """Photos per cell of `degrees` with their mean place; without a positive size every photo is a cell of its own."""
    if degrees <= 0:
        return photos.filter(is_valid_gps(F.col("lat"), F.col("lon"))).select(F.col("file_id").alias("cell_lon"), F.lit(0).cast("long").alias("cell_lat"), F.lit(1).cast("long").alias("n"), "lat", "lon")
    cell = [F.floor(F.col(c) / degrees).alias(f"cell_{c}") for c in ("lon", "lat")]
    return photos.filter(is_valid_gps(F.col("lat"), F.col("lon"))).groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def map_extent(photos: DataFrame) -> DataFrame:
    return photos.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def burst_gaps(photos: DataFrame, by: list[str], seconds: int = 2) -> DataFrame:
    """Burst number per owner: a gap over `seconds` to the previous photo starts a new one.

    Gaps are found within each owner's day; a small table of the days carries the last photo and the bursts so far.
    """
    key = [*by, "_day"]

    def near(now: Column, before: Column) -> Column:
        return F.unix_micros(now.cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= seconds * 1_000_000

    w = Window.partitionBy(*key).orderBy("captured", "name")
    rows = photos.withColumn("_day", F.col("captured").cast("date")).withColumn("_at", F.row_number().over(w))
    rows = rows.withColumn("_new", F.when((F.col("_at") == 1) | near(F.col("captured"), F.lag("captured").over(w)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("file_id", *key, "captured", "_new", "_run")
    days = rows.groupBy(*key).agg(F.min("captured").alias("lo"), F.max("captured").alias("hi"), F.sum("_new").alias("more"))
    d = Window.partitionBy(*by).orderBy("_day")
    days = days.withColumn("head", F.when(near(F.col("lo"), F.lag("hi").over(d)), 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("head") + F.col("more")).over(d.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*[F.col(c).alias(f"d_{c}") for c in key], (before + F.col("head")).alias("_start"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in key])
    return rows.join(days, same).select("file_id", *by, (F.col("_start") + F.col("_run")).alias("burst"))


def geofence_match(photos: DataFrame, bookmarks: DataFrame, cell: float = 1.0) -> DataFrame:
    """Photo x bookmark within its radius: bookmarks spread over the grid cells they can touch, equi-join, exact filter."""
    b = bookmarks.filter("radius_m > 0").filter(is_valid_gps(F.col("lat"), F.col("lon"))).select("ord", F.col("lat").alias("blat"), F.col("lon").alias("blon"), "radius_m")
    dlat = F.col("radius_m") / 111_000
    dlon = F.least(dlat / F.greatest(F.cos(F.radians(F.abs("blat") + dlat)), F.lit(1e-6)), F.lit(360.0))
    lats = F.sequence(F.floor((F.col("blat") - dlat) / cell), F.floor((F.col("blat") + dlat) / cell))
    lons = F.transform(F.sequence(F.floor((F.col("blon") - dlon) / cell), F.floor((F.col("blon") + dlon) / cell)), lambda x: F.pmod(x, F.lit(int(360 / cell))))
    b = b.withColumn("cy", F.explode(lats)).withColumn("cx", F.explode(F.array_distinct(lons)))
    p = photos.filter(is_valid_gps(F.col("lat"), F.col("lon"))).select("file_id", "lat", "lon", F.floor(F.col("lat") / cell).alias("cy"), F.pmod(F.floor(F.col("lon") / cell), F.lit(int(360 / cell))).alias("cx"))
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")) <= F.col("radius_m")
    return p.join(b, ["cy", "cx"]).filter(near).select("file_id", "ord").distinct()


def asof_before(photos: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """The last track point strictly before each photo: a tagged union, in windows of a key's day; a day without an earlier
    point takes the last one of the days before, from a table of days."""
    u = photos.select(*by, "captured", "file_id", F.lit(None).cast("timestamp_ntz").alias("pt")).unionByName(
        points.select(*by, "captured", F.lit(None).cast("long").alias("file_id"), F.col("captured").alias("pt"))
    ).withColumn("_day", F.to_date("captured"))
    key = [*by, "_day"]
    w = Window.partitionBy(*key).orderBy(F.col("captured"), F.col("file_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    last = u.filter("pt is not null").groupBy(*key).agg(F.max("pt").alias("_last"))
    days = u.select(*key).distinct().join(last, key, "left")
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*key, earlier.alias("_carried"))
    u = u.withColumn("before", F.last("pt", ignorenulls=True).over(w)).filter("file_id is not null")
    return u.join(days, key, "left").select("file_id", F.coalesce("before", "_carried").alias("before"))


def history_push(edits: DataFrame, by: list[str], order: str, depth: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return edits.withColumn("depth", F.row_number().over(w)).filter(F.col("depth") <= depth)
