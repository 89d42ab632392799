"""Registered queries of the library operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..sources.relations import oracle_from, relation

P, Y, B = oracle_from("photos"), oracle_from("photos_years"), oracle_from("bookmarks")
BOX = [-30.0, -60.0, 30.0, 60.0]
ALBUMS = {
    "good": [{"type": "minRating", "value": 3}],
    "red": [{"type": "colorLabel", "value": "red"}],
    "box": [{"type": "gpsBox", "value": BOX}, {"type": "keyword", "value": "K3"}],
}
HAV = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - p.lon) / 2), 2), 1.0)))"


def _photos(fn):
    return lambda spark, sf: fn(relation(spark, sf, "photos"))


def _years(fn):
    return lambda spark, sf: fn(relation(spark, sf, "photos_years"))


def _album(*clauses, mode="and"):
    return _photos(lambda p: L.smart_album(p, list(clauses), mode).select("file_id"))


def _asof(p):
    return L.asof_before(p.filter("event_type <> 'view'"), p.filter("event_type = 'view'"), ["user_id"])


QUERIES = {
    "clause_min_rating": _album({"type": "minRating", "value": 3}),
    "clause_keyword": _album({"type": "keyword", "value": "K3"}),
    "clause_color_label": _album({"type": "colorLabel", "value": "RED"}),
    "clause_pick_state": _album({"type": "pickState", "value": "Picked"}),
    "clause_date_range": _album({"type": "dateRange", "from": "2024-01-05 00:00:00", "to": "2024-01-12 00:00:00"}),
    "clause_gps_box": _album({"type": "gpsBox", "value": BOX}),
    "smart_album_eval": _album({"type": "minRating", "value": 5}, {"type": "colorLabel", "value": "Blue"}, mode="or"),
    "smart_albums_membership": _photos(lambda p: L.smart_albums_membership(p, ALBUMS)),
    "timeline_histogram_day": _photos(lambda p: L.timeline_histogram(p, "day")),
    "timeline_histogram_week": _years(lambda p: L.timeline_histogram(p, "week")),
    "timeline_histogram_month": _years(lambda p: L.timeline_histogram(p, "month")),
    "timeline_histogram": _years(L.timeline_histogram),
    "clause_keyword_case": _album({"type": "keyword", "value": "Bea", "caseSensitive": True}),
    "clause_person": lambda spark, sf: L.smart_album(relation(spark, sf, "photos"), [{"type": "person", "value": "p1"}], regions=relation(spark, sf, "regions")).select("file_id"),
    "clause_location": _album({"type": "location", "value": "y3"}),
    "person_timeline": _years(L.person_timeline),
    "memories_day": _years(lambda p: L.memories(p, "2002-06-15").filter("time_window = 'Day' and years_ago > 0").select("file_id", "years_ago")),
    "memories": _years(lambda p: L.memories(p, "1995-06-15")),
    "geo_grid_cluster": _photos(lambda p: L.geo_grid_cluster(p, 10.0)),
    "map_extent": _photos(L.map_extent),
    "burst_gaps": _photos(lambda p: L.burst_gaps(p, ["event_type"], 600)),
    "geofence_match": lambda spark, sf: L.geofence_match(relation(spark, sf, "photos"), relation(spark, sf, "bookmarks")),
    "gpx_asof_before": _photos(_asof),
    "history_push": _photos(lambda p: L.history_push(p, ["user_id"], "file_id", 20).select("user_id", "file_id", F.col("depth").cast("long").alias("depth"))),
}


def _where(cond: str) -> str:
    return f"select file_id from {P} p where {cond}"


def _dense(rel: str, unit: str, step: str) -> str:
    return f"""with c as (select cast(date_trunc('{unit}', captured) as date) bucket, count(*) n from {rel} p group by 1),
    s as (select cast(unnest(generate_series(min(bucket), max(bucket), interval {step})) as date) bucket from c)
    select s.bucket, coalesce(n, 0) n from s left join c on s.bucket = c.bucket"""


_BOX = f"lat between {BOX[0]} and {BOX[2]} and lon between {BOX[1]} and {BOX[3]}"
SQL = {
    "clause_min_rating": _where("coalesce(rating, 0) >= 3"),
    "clause_keyword": _where("contains(lower(keyword), 'k3')"),
    "clause_color_label": _where("lower(color_label) = 'red'"),
    "clause_pick_state": _where("coalesce(rating, 0) >= 0"),
    "clause_date_range": _where("captured between timestamp '2024-01-05' and timestamp '2024-01-12'"),
    "clause_gps_box": _where(_BOX),
    "smart_album_eval": _where("coalesce(rating, 0) >= 5 or color_label = 'Blue'"),
    "smart_albums_membership": f"""select album, count(*) n from (select 'good' album from {P} p where coalesce(rating, 0) >= 3
      union all select 'red' from {P} p where color_label = 'Red' union all select 'box' from {P} p where {_BOX} and keyword = 'k3') group by 1""",
    "timeline_histogram_day": _dense(P, "day", "1 day"),
    "timeline_histogram_week": _dense(Y, "week", "7 days"),
    "timeline_histogram_month": _dense(Y, "month", "1 month"),
    "timeline_histogram": _dense(Y, "month", "1 month"),
    "clause_keyword_case": _where("len(list_filter(keywords, lambda x: contains(x, 'Bea'))) > 0"),
    "clause_person": _where(f"len(list_filter(coalesce(persons_shown, []), lambda x: contains(lower(x), 'p1'))) > 0 or file_id in (select file_id from {oracle_from('regions')} r where category = 'Person' and contains(lower(label), 'p1'))"),
    "clause_location": _where(" or ".join(f"contains(lower(coalesce({c}, '')), 'y3')" for c in L.PLACES)),
    "person_timeline": f"""select a.person, a.year, a.n, b.first_seen, b.last_seen from
      (select person, cast(year(captured) as int) as year, count(*) n from {Y} p group by 1, 2) a
      join (select person, cast(min(captured) as date) first_seen, cast(max(captured) as date) last_seen from {Y} p group by 1) b on a.person = b.person""",
    "memories_day": f"select file_id, cast(2002 - year(captured) as int) years_ago from {Y} p where month(captured) = 6 and day(captured) = 15 and year(captured) < 2002",
    "memories": f"""with c as (select file_id, captured, cast(year(captured) as int) y from {Y} p)
      select file_id, 'Day' time_window, y as key, 1995 - y years_ago from c where y <> 1995 and month(captured) = 6 and day(captured) = 15
      union all select file_id, 'Week', y, 1995 - y from c where y <> 1995 and weekofyear(captured) = weekofyear(date '1995-06-15')
      union all select file_id, 'Month', y, 1995 - y from c where y <> 1995 and month(captured) = 6
      union all select file_id, 'Year', y, 0 from c where y = 1995
      union all select file_id, 'Decade', cast(y // 10 * 10 as int), cast(1990 - y // 10 * 10 as int) from c where y // 10 <> 199""",
    "geo_grid_cluster": f"""select cast(floor(p.lon / 10) as bigint) cell_lon, cast(floor(p.lat / 10) as bigint) cell_lat, count(*) n,
      round(avg(p.lat), 6) lat, round(avg(p.lon), 6) lon from {P} p group by 1, 2""",
    "map_extent": f"select min(lat) min_lat, max(lat) max_lat, min(lon) min_lon, max(lon) max_lon from {P} p",
    "burst_gaps": f"""select file_id, event_type, cast(sum(brk) over (partition by event_type order by captured, name rows unbounded preceding) as bigint) burst from
      (select *, case when captured - lag(captured) over (partition by event_type order by captured, name) <= interval 600 seconds then 0 else 1 end brk from {P} p)""",
    "geofence_match": f"select p.file_id, b.ord from {P} p, {B} b where {HAV} <= b.radius_m",
    "gpx_asof_before": f"""select p.file_id, max(t.captured) as before from {P} p left join {P} t
      on t.user_id = p.user_id and t.event_type = 'view' and t.captured < p.captured where p.event_type <> 'view' group by 1""",
    "history_push": f"select user_id, file_id, depth from (select user_id, file_id, row_number() over (partition by user_id order by file_id desc) depth from {P} p) where depth <= 20",
}

from . import edits, more, vision  # noqa: E402

QUERIES |= more.Q | edits.Q | vision.Q
SQL |= more.SQL | edits.SQL | vision.SQL
