"""Registered queries of search, places, faces, names, orders and edits, each beside the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import faces as A
from ..operators import library as L
from ..operators import naming as N
from ..operators import ordered as O
from ..operators import places as G
from ..operators import search as S
from ..sources import readers as R
from ..sources.relations import oracle_from, relation, shaped
from ..streaming import jobs as T

P, Y, B, REG, NAMES, ED, LOG, HASH, CAND = (oracle_from(x) for x in ("photos", "photos_years", "bookmarks", "regions", "file_names", "edits", "collection_log", "hashes", "candidates"))


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2), 1.0)))"


def on(*names):
    """A query over relations: the function takes one DataFrame per name."""
    return lambda fn: lambda spark, sf: fn(*[relation(spark, sf, n) for n in names])


photos, years, regions = on("photos"), on("photos_years"), on("regions")
both = on("photos", "regions")
ids = lambda df: df.select("file_id")
Q, SQL = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        SQL[name] = sql


# Search -------------------------------------------------------------------------------------------------------------
_PLACES = ["location", "city", "state", "country", "country_code"]
_has = lambda cols, needle: "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{needle}')" for c in cols) + ")"
add("library_search", both(lambda p, r: ids(S.library_search(p, r, any_text="trip", keyword="CK", person="p1", location="t1", min_rating=0))),
    f"""select file_id from {P} p where ({_has(['title', 'caption', *_PLACES], 'trip')} or len(list_filter(keywords, lambda k: contains(lower(k), 'trip'))) > 0 or file_id in (select file_id from {REG} r where contains(lower(label), 'trip')))
      and len(list_filter(keywords, lambda k: contains(lower(k), 'ck'))) > 0 and {_has(_PLACES, 't1')}
      and file_id in (select file_id from {REG} r where category = 'Person' and contains(lower(label), 'p1')) and coalesce(rating, 0) >= 0""")
add("any_text_haystack", both(lambda p, r: ids(S.any_text_haystack(p, r).filter(F.exists("haystack", lambda x: L.contains_ci(x, "p13"))))),
    f"select distinct file_id from {REG} r where contains(lower(label), 'p13')")
add("search_index", both(lambda p, r: S.search_index(p, r).select("file_id", "search_text")),
    f"""select p.file_id, lower(array_to_string(list_filter([name, dir, dir || '/' || name, title, caption, {', '.join(_PLACES)}, creator, headline] || keywords || coalesce(persons_shown, []) || coalesce(l, []), lambda x: x is not null and trim(x) <> ''), ' ')) search_text
      from {P} p left join (select file_id, list(label order by idx) l from {REG} r group by 1) r on r.file_id = p.file_id""")
add("grid_filter", photos(lambda p: ids(S.grid_filter(p, text="img click", stars=2, label="red", mode="HideRejects"))),
    f"select file_id from {P} p where event_type = 'click' and coalesce(rating, 0) >= 2 and color_label = 'Red' and not is_reject")
add("pick_reject_filter", photos(lambda p: ids(S.pick_reject_filter(p, "PicksOnly"))), f"select file_id from {P} p where is_pick")
add("timeline_drill", photos(lambda p: ids(S.timeline_drill(p, "2024-01-05", "1 day"))), f"select file_id from {P} p where cast(captured as date) = date '2024-01-05'")
add("newest_first", photos(lambda p: S.newest_first(p).select("file_id", "mtime")), f"select file_id, mtime from {P} p")
add("selection_semi", on("photos", "file_names")(lambda p, f: ids(S.selection_semi(p, p.filter("user_id % 7 = 0").select(F.upper(F.concat_ws("/", "dir", "name")).alias("path"))))), f"select file_id from {P} p where user_id % 7 = 0")
add("distinct_keywords", photos(lambda p: S.distinct_keywords(p).select("keyword", "n")), f"select min(k) keyword, count(*) n from (select unnest(keywords) k from {P} p) group by lower(k)")
add("distinct_people", regions(lambda r: S.distinct_people(r).select("person", "n")), f"select label person, count(*) n from {REG} r where category = 'Person' group by 1")
add("distinct_locations", photos(lambda p: S.distinct_locations(p).select("place", "n")),
    f"select place, count(*) n from (select unnest([location, city, state, country]) place from {P} p) where trim(coalesce(place, '')) <> '' group by 1")
add("effective_faces", regions(lambda r: A.effective_faces(r).select("file_id", "idx", "label")), f"select file_id, idx, label from {REG} r where category = 'Person' and status = 'Accepted'")
add("looks_equirectangular", photos(lambda p: S.looks_equirectangular(p.select("file_id", "keywords", (F.lit(1000) + F.col("file_id") % 5000).alias("width"), (F.lit(500) + F.col("user_id") * 10).alias("height"))).select("file_id", "equirectangular")),
    f"""select file_id, abs(cast(1000 + file_id % 5000 as double) / (500 + user_id * 10) - 2) <= 0.1 or (1000 + file_id % 5000 >= 4096 and cast(1000 + file_id % 5000 as double) / (500 + user_id * 10) >= 1.7) equirectangular from {P} p""")

# Places -------------------------------------------------------------------------------------------------------------
_TRACK = f"(select user_id, captured, lat, lon from {P} p where event_type = 'view')"
_SHOTS = f"(select * from {P} p where event_type <> 'view')"
_ASOF = f"""with s as (select file_id, user_id, captured, lat olat, lon olon, epoch_us(captured) / 1e6 t from {_SHOTS} x), k as (select user_id, lat, lon, epoch_us(captured) / 1e6 t from {_TRACK} y),
  m as (select s.*, a.t ta, a.lat la, a.lon oa, b.t tb, b.lat lb, b.lon ob from s
    asof left join k a on s.user_id = a.user_id and s.t > a.t asof left join k b on s.user_id = b.user_id and s.t <= b.t),
  h as (select *, case when tb - ta <= 1200 then 'between' when t - ta <= 600 and (tb is null or t - ta <= tb - t) then 'before' when tb - t <= 600 then 'after' end how,
    case when tb - ta > 0 then (t - ta) / (tb - ta) else 0 end f from m)"""
_points = lambda p: p.filter("event_type = 'view'")
_shots = lambda p: p.filter("event_type <> 'view'")
add("gpx_asof_match", photos(lambda p: G.gpx_asof_match(_shots(p), _points(p), ["user_id"], 600).select("file_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "how")),
    f"""{_ASOF} select file_id, round(case how when 'between' then la + f * (lb - la) when 'before' then la else lb end, 6) lat,
      round(case how when 'between' then oa + f * (ob - oa) when 'before' then oa else ob end, 6) lon, how from h where how is not null""")
_no_gps = lambda p: p.withColumn("lat", F.when(F.col("file_id") % 3 == 0, F.col("lat")))
add("gpx_geotag_batch", photos(lambda p: G.gpx_geotag_batch(_no_gps(_shots(p)), _points(p), ["user_id"], 600)),
    f"{_ASOF} select file_id, case when file_id % 3 = 0 then 'already has GPS' when how is null then 'no trackpoint within tolerance' else 'matched' end outcome from h")
add("camera_offset_calibrate", photos(lambda p: G.camera_offset_calibrate(p.select(F.col("event_type").alias("camera"), (F.col("captured") + F.expr("interval 90 seconds")).alias("local"), F.col("captured").alias("utc"))).select("camera", F.round("offset_s", 3).alias("offset_s"), "n")),
    f"select event_type camera, cast(90 as double) offset_s, count(*) n from {P} p group by 1")
_FENCE = f"select p.file_id, min(b.ord) ord from {P} p, {B} b where {hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} <= b.radius_m group by 1"
_fences = lambda b: b.withColumns({"city": F.when(F.col("ord") % 4 > 0, F.col("name")), "state": F.lit(" "), "country": F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Land"), (F.col("ord") % 5).cast("string")))})
add("geofence_batch", on("photos", "bookmarks")(lambda p, b: G.geofence_batch(p, _fences(b)).select("file_id", "ord", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "location", "city", "state", "country", "would_write")),
    f"""with e as (select m.file_id, m.ord, b.lat, b.lon, case when trim(coalesce(p.city, '')) = '' and m.ord % 4 > 0 then b.name end city, case when p.country is null and m.ord % 3 = 0 then 'Land' || (m.ord % 5) end country
      from ({_FENCE}) m join {P} p on p.file_id = m.file_id join {B} b on b.ord = m.ord)
      select file_id, ord, round(lat, 6) lat, round(lon, 6) lon, null::varchar as location, city, null::varchar state, country, city is not null or country is not null would_write from e""")
_GAZ = f"(select distinct round(lat, 1) lat4, round(lon, 1) lon4 from {P} p where user_id % 2 = 0)"
add("reverse_geocode_join", photos(lambda p: G.reverse_geocode_join(p, p.filter("user_id % 2 = 0").select(G.steps(F.col("lat"), 1).alias("lat4"), G.steps(F.col("lon"), 1).alias("lon4")).distinct().withColumn("place", F.lit("Town")), places=1)),
    f"""with g as {_GAZ}, j as (select p.file_id, p.city, g.lat4 is not null hit from {P} p left join g on round(p.lat, 1) = g.lat4 and round(p.lon, 1) = g.lon4),
      o as (select *, case when not hit then 'NoMatch' when trim(coalesce(city, '')) <> '' then 'AlreadyTagged' else 'Resolved' end outcome from j)
      select file_id, outcome, case when outcome = 'Resolved' then 'Town' else city end city_after from o""")
add("elevation_join", photos(lambda p: G.elevation_join(p, p.filter("file_id % 2 = 0").select(F.round("lat", 5).alias("lat5"), F.round("lon", 5).alias("lon5")).distinct().withColumn("altitude", F.round(F.col("lat5") * 10, 3)))),
    f"""with g as (select distinct round(lat, 5) lat5, round(lon, 5) lon5 from {P} p where file_id % 2 = 0)
      select p.file_id, round(g.lat5 * 10, 3) altitude from {P} p left join g on round(p.lat, 5) = g.lat5 and round(p.lon, 5) = g.lon5""")
_docs = lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.encode("text", "utf-8").alias("content"))
add("exact_duplicate_files", lambda spark, sf: G.exact_duplicate_files(_docs(spark, sf)),
    "select d.doc_id file_id, g.first_id, g.n from documents d join (select text, min(doc_id) first_id, count(*) n from documents group by 1 having count(*) > 1) g on d.text = g.text")
add("content_fingerprint", lambda spark, sf: G.content_fingerprint(_docs(spark, sf)),
    """select doc_id file_id, sha256(unhex(concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))
      || left(hex(encode(text)), 131072))) fingerprint from (select doc_id, text, printf('%016X', octet_length(encode(text))) h from documents)""")
add("nearby_radius", photos(lambda p: G.nearby_radius(p, 10.0, 20.0, 2_000_000).select("file_id", F.round("distance_m", 1).alias("distance_m"))),
    f"select file_id, round(d, 1) distance_m from (select file_id, {hav('lat', 'lon', '10.0', '20.0')} d from {P} p) where d <= 2000000")
add("on_this_trip", photos(lambda p: G.on_this_trip(p, 10.0, 20.0, "2024-01-15 12:00:00", 3000, 5).select("file_id", F.round("distance_m", 1).alias("distance_m"))),
    f"select file_id, round(d, 1) distance_m from (select file_id, captured, {hav('lat', 'lon', '10.0', '20.0')} d from {P} p) where d <= 3000000 and abs(epoch(captured) - epoch(timestamp '2024-01-15 12:00:00')) <= 5 * 86400")
_MARKS = f"(select file_id, lat * 0.9 lat, lon * 0.9 lon, lat * 0.9 + 1 mark_lat, lon * 0.9 + 2 mark_lon, cast(user_id % 40 as double) angle from {P} p)"
_BEAR = "degrees(atan2(sin(radians(mark_lon - lon)) * cos(radians(mark_lat)), cos(radians(lat)) * sin(radians(mark_lat)) - sin(radians(lat)) * cos(radians(mark_lat)) * cos(radians(mark_lon - lon)))) - angle"
add("camera_heading", photos(lambda p: G.camera_heading(p.select("file_id", (F.col("lat") * 0.9).alias("lat"), (F.col("lon") * 0.9).alias("lon"), (F.col("lat") * 0.9 + 1).alias("mark_lat"), (F.col("lon") * 0.9 + 2).alias("mark_lon"), (F.col("user_id") % 40).cast("double").alias("pixel_angle"))).select("file_id", F.round("heading", 5).alias("heading"), "marks")),
    f"select file_id, round(h - 360 * floor(h / 360), 5) heading, cast(1 as bigint) marks from (select file_id, {_BEAR} h from {_MARKS})")
add("camera_target", photos(lambda p: G.camera_target(p.withColumn("heading", (F.col("user_id") % 360).cast("double")).withColumn("lat", F.col("lat") * 0.9), 1000.0).select("file_id", F.round("target_lat", 6).alias("target_lat"), F.round("target_lon", 6).alias("target_lon"))),
    f"""with s as (select file_id, radians(lat * 0.9) a, lon, radians(cast(user_id % 360 as double)) t, 1000 / 6371008.8 d from {P} p),
      q as (select *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) la from s), r as (select *, lon + degrees(atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(la))) + 180 x from q)
      select file_id, round(degrees(la), 6) target_lat, round(x - 360 * floor(x / 360) - 180, 6) target_lon from r""")
add("geo_cluster_for_zoom", photos(lambda p: L.geo_grid_cluster(p, G.geo_cluster_degrees(20_000.0)).select("cell_lon", "cell_lat", "n")),
    f"select cast(floor(lon / d) as bigint) cell_lon, cast(floor(lat / d) as bigint) cell_lat, count(*) n from (select lat, lon, 40 * 20000.0::double / (40075016::double / 360) d from {P} p) group by 1, 2")
add("map_extent_padded", photos(G.map_extent_padded),
    f"""with m as (select radians(lon) * 6378137 x, ln(tan(radians(greatest(least(lat, 85), -85)) / 2 + 0.7853981633974483)) * 6378137 y from {P} p), b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from m)
      select round(x0 - (x1 - x0) * 0.1, 3) x0, round(x1 + (x1 - x0) * 0.1, 3) x1, round(y0 - (y1 - y0) * 0.1, 3) y0, round(y1 + (y1 - y0) * 0.1, 3) y1 from b""")
_PLACE = "array_to_string(list_filter([case when trim(city) <> '' then city end, country], lambda x: x is not null), ', ')"
add("export_kml", photos(lambda p: G.export_kml(p.withColumn("altitude", F.when(F.col("file_id") % 3 == 0, F.col("user_id") + F.lit(0.5).cast("double"))))),
    f"""select file_id, '<Placemark><name>' || coalesce(title, name) || '</name><description>' || array_to_string(list_filter([caption, nullif({_PLACE}, '')], lambda x: x is not null), '  \u00b7  ') || '</description><Point><coordinates>' || printf('%.6f,%.6f', lon, lat)
      || case when file_id % 3 = 0 then printf(',%.2f', user_id + 0.5) else '' end || '</coordinates></Point></Placemark>' placemark from {P} p""")
_near = hav("a.lat", "a.lon", "p.lat", "p.lon")
add("on_this_trips", photos(lambda p: G.on_this_trips(p, p.filter("file_id % 100 = 0").select(F.col("file_id").alias("anchor_id"), "lat", "lon", "captured"), 900.0, 3.0).select("anchor_id", "file_id", F.round("distance_m", 1).alias("distance_m"))),
    f"""select anchor_id, file_id, round(d, 1) distance_m from (select a.file_id anchor_id, p.file_id, {_near} d, abs(epoch(a.captured) - epoch(p.captured)) s from {P} a join {P} p on a.file_id % 100 = 0 and abs(epoch(a.captured) - epoch(p.captured)) <= 3 * 86400)
      where d <= 900000 and (d >= 1 or s >= 1)""")
_focal = lambda: (F.col("user_id") % 50 - 5).cast("double")
add("camera_sight", photos(lambda p: p.select("file_id", F.round(G.fov_of_focal(_focal()), 6).alias("fov"), F.round(G.pixel_angle(F.col("file_id") % 4000, F.when(F.col("file_id") % 9 > 0, F.lit(4000)).otherwise(0), G.fov_of_focal(_focal())), 6).alias("angle"))),
    f"""select file_id, round(fov, 6) fov, case when file_id % 9 > 0 then round((file_id % 4000 / 4000 - 0.5) * fov, 6) end angle from (select file_id, case when user_id % 50 > 5 then degrees(2 * atan(18.0 / (user_id % 50 - 5))) end fov from {P} p)""")
add("dms_round_trip", photos(lambda p: p.select("file_id", geo.dms_format(F.col("lat"), "N", "S").alias("text"), F.round(geo.dms_parse(geo.dms_format(F.col("lat"), "N", "S")), 6).alias("parsed"))),
    f"""select file_id, (m // 60000000) || ',' || (m % 60000000 // 1000000) || '.' || lpad(cast(m % 1000000 as varchar), 6, '0') || case when lat < 0 then 'S' else 'N' end as text, round(lat, 6) parsed
      from (select file_id, lat, cast(round(abs(lat) * 60000000) as bigint) m from {P} p)""")

# Regions and faces --------------------------------------------------------------------------------------------------
add("scan_faces", regions(lambda r: A.scan_faces(r).select("file_id", "idx")), f"select file_id, idx from {REG} r where category = 'Person'")
_things = lambda r: r.withColumn("label", F.when(F.col("idx") == 3, "Teddy Bear").when((F.col("idx") == 2) & (F.col("file_id") % 2 == 0), "PERSON").otherwise(F.col("label")))
_KIND = "case when idx = 3 then 'Item' when idx = 2 and file_id % 2 = 0 then 'Person' when label = 'dog' then 'Animal' else 'Other' end"
add("region_category", regions(lambda r: _things(r).select("file_id", "idx", A.region_category(F.col("label")).alias("kind"))), f"select file_id, idx, {_KIND} kind from {REG} r")
add("propose_regions", regions(lambda r: A.propose_regions(_things(r)).select("file_id", "idx", "category", "status")), f"select file_id, idx, {_KIND} category, 'Proposed' status from {REG} r where score >= 0.3")
_OVER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
add("box_iou_pairs", regions(lambda r: A.box_iou_pairs(r, 0.1).select("file_id", "a", "b", F.round("iou", 6).alias("iou"))),
    f"select * from (select a.file_id, a.idx a, b.idx b, round({_OVER} / (a.w * a.h + b.w * b.h - {_OVER}), 6) iou from {REG} a join {REG} b on a.file_id = b.file_id and a.idx < b.idx) where iou > 0.1")
_twice = lambda r: r.unionByName(r.withColumn("idx", F.col("idx") + 4).withColumn("x", F.col("x") + 0.0001))
add("dedupe_regions", regions(lambda r: A.dedupe_regions(_twice(r)).select("file_id", "idx")), f"select file_id, min(idx) idx from (select file_id, idx, round(x, 3) x, round(y, 3) y, round(w, 3) w, round(h, 3) h, category from {REG} r) group by file_id, x, y, w, h, category")
_HALF = "case when idx % 2 = 1 then 0.5 else 1 end"
_halved = lambda r: r.withColumns({c: F.col(c) * F.when(F.col("idx") % 2 == 1, 0.5).otherwise(1.0) for c in ("w", "h")})
add("suppress_body_boxes", regions(lambda r: A.suppress_body_boxes(_halved(r)).select("file_id", "idx")),
    f"""with r as (select file_id, idx, category, x, y, w * {_HALF} w, h * {_HALF} h from {REG} q) select file_id, idx from r a where not (category = 'Person' and exists (select 1 from r b where b.file_id = a.file_id and b.idx <> a.idx
      and b.category = 'Person' and b.x >= a.x - 0.02 and b.y >= a.y - 0.02 and b.x + b.w <= a.x + a.w + 0.02 and b.y + b.h <= a.y + a.h + 0.02 and b.w * b.h <= 0.4 * (a.w * a.h)))""")
_IOU = "greatest(least(o.x + o.w, d.x + d.w) - greatest(o.x, d.x), 0) * greatest(least(o.y + o.h, d.y + d.h) - greatest(o.y, d.y), 0)"
add("nms", regions(lambda r: A.nms(r, 0.3, ["file_id"]).select("file_id", "idx")),
    f"""with recursive s as (select file_id, idx, {{'x': x::double, 'y': y::double, 'w': w::double, 'h': h::double}} d, row_number() over (partition by file_id order by score desc, idx) k from {REG} r),
      n as (select file_id, 1::bigint k, [d] kept, idx, true stays from s where k = 1 union all select file_id, k, case when stays then kept || [d] else kept end, idx, stays from
        (select s.*, n.kept, len(list_filter(n.kept, lambda o: {_IOU} > 0.3 * (o.w * o.h + d.w * d.h - {_IOU}))) = 0 stays from n join s on s.file_id = n.file_id and s.k = n.k + 1))
      select file_id, idx from n where stays""")
add("detected_keywords", regions(lambda r: A.detected_keywords(r).select("file_id", F.array_join("labels", ",").alias("labels"))), f"select file_id, array_to_string(list_sort(list_distinct(list(label))), ',') as labels from {REG} r group by 1")
_faces = lambda spark, sf: spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("face_id"), F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("P"), F.col("label").cast("string"))).alias("name"), "label", "embedding")
_NAMED = "(select vec_id face_id, case when vec_id % 4 = 0 then 'P' || label end as name, case when vec_id % 11 > 0 then embedding end embedding from embeddings)"
add("face_groups_by_name", lambda spark, sf: A.face_groups_by_name(_faces(spark, sf)).select("face_id", "cluster_id"),
    f"""with k as (select *, case when name is not null then dense_rank() over (partition by name is null order by lower(name)) end k from {_NAMED} f)
      select face_id, coalesce(k, (select coalesce(max(k), 0) from k) + row_number() over (partition by name is null order by face_id)) cluster_id from k""")
_blind = lambda spark, sf: _faces(spark, sf).withColumn("embedding", F.when(F.col("face_id") % 11 > 0, F.col("embedding")))
add("face_clusters_embedding", lambda spark, sf: A.face_clusters_embedding(_blind(spark, sf), 0.4).select("face_id", "cluster_id"),
    f"""with recursive f as (select *, lower(name) k from {_NAMED} f), u as (select face_id, list_transform(embedding, lambda x: x::double) v from f where name is null and embedding is not null),
      e as (select a.face_id a, b.face_id b from u a, u b where a.face_id <> b.face_id and list_cosine_similarity(a.v, b.v) >= 0.4),
      r as (select face_id a, face_id b from u union select r.a, e.b from r join e on r.b = e.a),
      c as (select a face_id, min(b) root, count(*) n from r group by 1),
      all_ as (select face_id, 0 part, k, 0 n, 0 root from f where name is not null union all select face_id, 1, null, -n, root from c union all select face_id, 2, null, 0, face_id from f where name is null and embedding is null)
      select face_id, dense_rank() over (order by part, k, n, root) cluster_id from all_""")
_UNIT = "(select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings)"
_MEAN = "(select label, avg_n n, v from (select label, list(x order by i) v from (select label, i, avg(x) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2) group by 1) join (select label, count(*) avg_n from embeddings group by 1) using (label))"
add("face_cluster_centroid", lambda spark, sf: A.face_cluster_centroid(_faces(spark, sf), "label").select("label", "n", F.round(F.element_at("centroid", 1), 6).alias("c1"), F.round(F.element_at("centroid", 64), 6).alias("c64")),
    f"select label, n, round(v[1] / sqrt(list_inner_product(v, v)), 6) c1, round(v[64] / sqrt(list_inner_product(v, v)), 6) c64 from {_MEAN}")
add("nearest_named_clusters", lambda spark, sf: A.nearest_named_clusters(A.face_cluster_centroid(_faces(spark, sf), "label"), "label", 3).select("a", "b", "rank"),
    f"select a, b, rank from (select x.label a, y.label b, row_number() over (partition by x.label order by list_cosine_similarity(x.v, y.v) desc, y.label) rank from {_MEAN} x join {_MEAN} y on x.label <> y.label) where rank <= 3")
_vocab = lambda f: A.face_cluster_centroid(f, "label").select(F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"), F.col("centroid").alias("vector"))
add("auto_keywords", lambda spark, sf: A.auto_keywords(_faces(spark, sf).withColumnRenamed("face_id", "file_id"), _vocab(_faces(spark, sf)), 2),
    f"""select file_id, word, rank from (select e.vec_id file_id, 'w' || m.label word, row_number() over (partition by e.vec_id order by list_cosine_similarity(e.v, m.v) desc, 'w' || m.label) rank
      from {_UNIT} e, {_MEAN} m where list_cosine_similarity(e.v, m.v) >= 0.22) where rank <= 2""")
# Every second known face stands for its name; a face is then known by the nearest of another vector, if near enough.
_known = lambda spark, sf: _faces(spark, sf).filter("face_id % 2 = 0").select(F.concat(F.lit("w"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("vector"))
add("face_known_match", lambda spark, sf: A.face_known_match(_faces(spark, sf).drop("name"), _known(spark, sf), 0.35),
    f"""select face_id, known_as from (select e.vec_id face_id, 'w' || m.label known_as, row_number() over (partition by e.vec_id order by list_cosine_similarity(e.v, m.v) desc, 'w' || m.label) rank
      from {_UNIT} e, {_UNIT} m where m.vec_id % 2 = 0 and list_cosine_similarity(e.v, m.v) > 0.35) where rank = 1""")

# Orders and plans ---------------------------------------------------------------------------------------------------
_bursts = lambda p: O.burst_groups(p, ["user_id"], 600.0, 3)
# The fold over a session's files as a recursion: a file starts a burst after a gap, or where its stem is too far from the burst's first.
_FOLD = f"""with recursive g as (select user_id, file_id, regexp_replace(name, '\\.[^.]*$', '') s, row_number() over w k, case when epoch_us(captured) - lag(epoch_us(captured)) over w <= 600000000 then 0 else 1 end cut from {P} p window w as (partition by user_id order by captured, name, file_id)),
      b as (select user_id, k, file_id, s head, file_id burst_first from g where k = 1 union all select user_id, k, file_id, case when new then s else head end, case when new then file_id else burst_first end from
        (select g.*, b.head, b.burst_first, g.cut = 1 or greatest(length(b.head), length(g.s)) - coalesce(list_max(list_filter(range(1, least(length(b.head), length(g.s)) + 1), lambda n: left(lower(b.head), n) = left(lower(g.s), n))), 0) > 3 new
         from b join g on g.user_id = b.user_id and g.k = b.k + 1))"""
add("burst_groups", photos(lambda p: _bursts(p).select("file_id", "burst_first")), f"{_FOLD} select file_id, burst_first from b")
add("burst_sessions", photos(lambda p: O.burst_groups(p, ["user_id"], 600.0, 1000).select("file_id", "burst_first")),
    f"""with g as (select *, case when epoch_us(captured) - lag(epoch_us(captured)) over w <= 600000000 then 0 else 1 end cut from {P} p window w as (partition by user_id order by captured, name)),
      s as (select *, sum(cut) over (partition by user_id order by captured, name rows unbounded preceding) k from g)
      select file_id, first_value(file_id) over (partition by user_id, k order by captured, name) burst_first from s""")
add("burst_summary", photos(lambda p: O.burst_summary(_bursts(p))), f"{_FOLD} select count(*) bursts, count(*) filter (n > 1) multi, cast(coalesce(sum(n), 0) as bigint) files from (select count(*) n from b group by burst_first)")
add("burst_name", photos(lambda p: p.select("file_id", O.burst_name(O.stem(F.col("name")), O.stem(F.replace("name", F.lit("0."), F.lit("1.")))).alias("burst"))),
    f"select file_id, case when right(s, 1) = '0' then s || '..' || substr(left(s, length(s) - 1) || '1', 5) else s end burst from (select file_id, replace(name, '.jpg', '') s from {P} p)")
add("burst_tag", photos(lambda p: p.select("file_id", F.array_join(O.burst_tag(F.array_append("keywords", F.lit("PM:burstId=9")), F.col("file_id").cast("string")), ",").alias("tags"))), f"select file_id, array_to_string(keywords || ['pm:burstId=' || file_id], ',') tags from {P} p")
# Originals half an hour and two hours after the satellite's date, and a date that does not count.
_stale = lambda c: c.unionByName(c.filter("source = 'Gps' and file_id % 4 < 2").select("file_id", "n", (F.col("ts").cast("timestamp_ntz") + F.when(F.col("file_id") % 4 == 0, F.expr("interval 30 minutes")).otherwise(F.expr("interval 2 hours"))).alias("ts"), F.lit("SubIfd").alias("source")))
add("best_capture_date", on("candidates")(lambda c: O.best_capture_date(_stale(c.withColumn("ts", F.col("ts").cast("timestamp_ntz"))), ignored=("1980-01-01", "1995-01-10"))),
    f"""with c as (select file_id, ts::timestamp ts, source from {CAND} c), a as (select * from c union all select file_id, ts + case when file_id % 4 = 0 then interval 30 minute else interval 2 hour end, 'SubIfd' from c where source = 'Gps' and file_id % 4 < 2),
      o as (select * from a where ts <> timestamp '1995-01-10'), g as (select file_id, max(ts) filter (source = 'Gps') gps, max(ts) filter (source = 'SubIfd') sub from o group by 1),
      b as (select file_id, ts captured, source from (select *, row_number() over (partition by file_id order by case source when 'Gps' then 50 when 'SubIfd' then 40 when 'Ifd0' then 30 when 'FileName' then 20 when 'Modified' then 10 else 1 end desc, ts desc) k from o) where k = 1)
      select file_id, case when sub > gps and sub - gps <= interval 1 hour then sub else captured end captured, case when sub > gps and sub - gps <= interval 1 hour then 'SubIfd' else source end source from b join g using (file_id)""")
_clash = lambda y: y.select("file_id", F.date_format("captured", "yyyy/MM").alias("dir"), F.lit("IMG").alias("base"), F.lit(".jpg").alias("ext"), F.concat(F.lit("n"), F.col("file_id").cast("string")).alias("name"))
_disk = lambda y: _clash(y).filter("file_id % 40 = 0").select("dir", "base", "ext", F.lit(2).cast("long").alias("n")).distinct()
_NUM = f"""with f as (select file_id, strftime(captured, '%Y/%m') dir, row_number() over (partition by strftime(captured, '%Y/%m') order by 'n' || file_id, file_id) k from {Y} y),
  u as (select distinct strftime(captured, '%Y/%m') dir from {Y} y where file_id % 40 = 0), n as (select f.*, case when u.dir is not null and k >= 2 then k + 1 else k end m from f left join u on f.dir = u.dir)"""
add("collision_suffix", years(lambda y: O.collision_suffix(_clash(y), _disk(y))), f"{_NUM} select file_id, dir || '/IMG' || case when m > 1 then ' (' || m || ')' else '' end || '.jpg' final from n")
_held = lambda y: _clash(y).filter("file_id % 40 = 0").select("dir", "base", "ext", F.lit(0).cast("long").alias("n"), F.lit("s1").alias("sha")).distinct()
# A numbered sibling with a content of the batch's must not count; without a file on disk the batch's first holds the name.
_sibling = lambda y: _held(y).unionByName(_clash(y).filter("file_id % 24 = 0").select("dir", "base", "ext", F.lit(2).cast("long").alias("n"), F.lit("s2").alias("sha")).distinct())
_hashed = lambda y: _clash(y).withColumn("sha", F.concat(F.lit("s"), (F.col("file_id") % 5).cast("string")))
_PLAN = f"""with f as (select file_id, strftime(captured, '%Y/%m') dir, 's' || (file_id % 5) sha, 'n' || file_id name from {Y} y), u as (select distinct dir from f where file_id % 40 = 0), v as (select distinct dir from f where file_id % 24 = 0),
      c as (select f.*, u.dir is not null held, v.dir is not null two, row_number() over w rn, first_value(sha) over w first_sha from f left join u on f.dir = u.dir left join v on f.dir = v.dir window w as (partition by f.dir order by name, file_id)),"""
add("import_plan", years(lambda y: O.import_plan(_hashed(y), _sibling(y), "Smart")),
    f"""{_PLAN} o as (select *, case when not held and rn = 1 then 'imported' when sha = case when held then 's1' else first_sha end then 'skipped' else 'renamed' end outcome from c),
      n as (select *, row_number() over (partition by dir, outcome order by name, file_id) + 1 + case when two then 1 else 0 end m from o)
      select file_id, dir || '/IMG' || case when outcome = 'renamed' then ' (' || m || ')' else '' end || '.jpg' final, outcome from n""")
add("import_preview", years(lambda y: O.import_preview(_hashed(y), _sibling(y))), f"{_PLAN} x as (select 1) select file_id, dir || '/IMG.jpg' final, case when not held then 'import' when sha = 's1' then 'skip identical' else 'resolve conflict' end preview from c")
add("import_summary", years(lambda y: O.import_summary(O.import_plan(_clash(y).withColumn("sha", F.lit("s1")), _held(y), "Skip"))),
    f"""with f as (select file_id, strftime(captured, '%Y/%m') dir, 'n' || file_id name from {Y} y), u as (select distinct dir from f where file_id % 40 = 0),
      c as (select u.dir is not null or row_number() over (partition by f.dir order by name, file_id) > 1 clash from f left join u on f.dir = u.dir)
      select case when clash then 'skipped' else 'imported' end outcome, count(*) n from c group by 1""")
add("rename_plan", photos(lambda p: O.rename_plan(p, "{year}-{month}_{label}_{x}", ["dir"])),
    f"""with r as (select file_id, dir, name, captured, strftime(captured, '%Y-%m') || '_' || coalesce(color_label, '') || '_{{x}}.jpg' new_name from {P} p)
      select file_id, new_name, case when row_number() over (partition by dir, lower(new_name) order by captured, name, file_id) > 1 then 'duplicate' else 'rename' end status from r""")
add("rename_index", photos(lambda p: O.rename_plan(p, "a{index}", ["dir"])), f"select file_id, 'a' || row_number() over (partition by dir order by captured, name, file_id) || '.jpg' new_name, 'rename' status from {P} p")
add("rename_tokens", photos(lambda p: O.rename_plan(p, "{Date:yyyyMMdd} {time}_{City}/{countryCode}{caption}_{index:000}of{total}-{rating}{", ["dir"])),
    f"""with r as (select *, row_number() over (partition by dir order by captured, name, file_id) i, count(*) over (partition by dir) t from {P} p),
      s as (select *, strftime(captured, '%Y%m%d %H%M%S') || '_' || coalesce(city, '') || '_' || coalesce(country_code, '') || coalesce(caption, '') || '_' || case when i < 1000 then lpad(i::varchar, 3, '0') else i::varchar end || 'of' || t || '-' || coalesce(rating::varchar, '') || '{{.jpg' new_name from r)
      select file_id, new_name, case when row_number() over (partition by dir, lower(new_name) order by captured, name, file_id) > 1 then 'duplicate' else 'rename' end status from s""")
add("rename_all", photos(lambda p: O.rename_plan(p, "a{index:00000}")), f"select file_id, 'a' || lpad((row_number() over (order by captured, name, file_id))::varchar, 5, '0') || '.jpg' new_name, 'rename' status from {P} p")
add("history_rollback", photos(lambda p: O.history_rollback(p, ["user_id"], "file_id", 3).select("user_id", "file_id")), f"select user_id, file_id from (select user_id, file_id, row_number() over (partition by user_id order by file_id desc) k from {P} p) where k = 4")
_side = lambda p: p.filter("file_id % 3 = 0").select("dir", F.concat(F.upper("name"), F.lit(".copy"), (F.col("file_id") % 4).cast("string"), F.lit(".XMP")).alias("name"))
_copies = lambda p: O.virtual_copies(p.select("dir", "name"), _side(p))
add("virtual_copies", photos(_copies), f"select dir, name, file_id % 4 copy_index from {P} p where file_id % 3 = 0 and file_id % 4 > 0")
add("virtual_copy_next_index", photos(lambda p: O.virtual_copy_next_index(_copies(p))), f"select dir, name, cast(case when file_id % 4 = 1 then 2 else 1 end as bigint) next_index from {P} p where file_id % 3 = 0 and file_id % 4 > 0")
add("library_rows", photos(lambda p: O.library_rows(p, _copies(p))), f"select dir, name, cast(0 as bigint) copy_index from {P} p union all select dir, name, file_id % 4 from {P} p where file_id % 3 = 0 and file_id % 4 > 0")
add("quick_collection_toggle", on("collection_log")(O.quick_collection),
    f"""with c as (select seq, lower(path) path, op from {LOG} l where op <> 'clear' and seq > coalesce((select max(seq) from {LOG} l where op = 'clear'), -1)),
      l as (select path, max(seq) filter (op <> 'toggle') last_seq from c group by 1),
      s as (select l.path, coalesce(max(case when c.seq = l.last_seq and c.op = 'add' then 1 end), 0) + count(*) filter (c.op = 'toggle' and (l.last_seq is null or c.seq > l.last_seq)) k from l join c on c.path = l.path group by 1)
      select path from s where k % 2 = 1""")
add("stream_edit_fold", on("edits")(O.fold_edits), f"select path, field, value from (select *, row_number() over (partition by path, field order by seq desc) k from {ED} e where has_value) where k = 1")
add("apply_edits", on("photos", "edits")(lambda p, e: O.apply_edits(p.select("file_id", "user_id", F.lit("a").alias("click"), F.lit("b").alias("view")), e, "user_id", ["click", "view"])),
    f"""with v as (select path, field, value from (select *, row_number() over (partition by path, field order by seq desc) k from {ED} e where has_value) where k = 1)
      select p.file_id, p.user_id, case when c.path is null then 'a' else c.value end click, case when w.path is null then 'b' else w.value end as view from {P} p
      left join v c on c.path = p.user_id and c.field = 'click' left join v w on w.path = p.user_id and w.field = 'view'""")
add("pick_reject_edit", photos(lambda p: O.pick_reject_edit(p, "Reject").select("file_id", "is_pick", "is_reject")), f"select file_id, false is_pick, true is_reject from {P} p")
add("merge_keywords", photos(lambda p: p.select("file_id", F.array_join(O.merge_keywords(F.col("keywords"), F.array(F.lit(" BEACH "), F.lit(""), F.upper("keyword"), F.lit("New"))), ",").alias("merged"))), f"select file_id, array_to_string(keywords || ['New'], ',') merged from {P} p")
add("keyword_add_remove", photos(lambda p: p.select("file_id", F.array_join(O.keyword_remove(F.col("keywords"), "BEACH"), ",").alias("left_over"))), f"select file_id, event_type || ',' || keyword left_over from {P} p")
add("fill_place_fields", photos(lambda p: p.select("file_id", O.fill_place(F.col("city"), F.col("country")).alias("city"))), f"select file_id, case when trim(coalesce(city, '')) = '' and country is not null then country else city end city from {P} p")
add("shuffle", photos(lambda p: ids(O.shuffle(p, 7))), f"select file_id from {P} p")

# Names, dates, formats ----------------------------------------------------------------------------------------------
_stamped = lambda f: f.withColumn("created", F.col("created").cast("timestamp_ntz")).withColumn("modified", F.col("created") + F.when(F.col("file_id") % 3 == 0, F.expr("interval -27 hours")).otherwise(F.expr("interval 5 hours"))).withColumn("name", F.when(F.col("file_id") % 6 == 4, F.concat(F.lit("Foto 31-12-9"), (F.col("file_id") % 10).cast("string"), F.lit(" 990215_070809.png"))).otherwise(F.col("name")))


def _layout_sql(layout: str) -> str:
    """One layout's dates by DuckDB's patterns with named parts."""
    names, pattern = [], ""
    for part in re.findall("y+|M+|d+|H+|m+|s+|.", layout):
        if part in "-_":
            pattern += r"[-_./\\\\:]*"
        elif part == " ":
            pattern += " "
        else:
            names.append("mo" if part[0] == "M" else part[0])
            pattern += f"([0-9]{{{len(part)}}})"
    got = lambda c, other: f"p['{c}']" if c in names else other
    year = got("y", "''")
    year = f"case when {year} < '50' then '20' else '19' end || {year}" if "yyyy" not in layout else year
    clock = ":".join("' || " + (got(c, f"lpad({f}(base)::varchar, 2, '0')")) + " || '" for c, f in (("H", "hour"), ("m", "minute"), ("s", "second")))
    whole_day = "p['H'] < '24' and" if "H" in names else ""  # DuckDB reads 24:00 as the next day
    return f"""select file_id, '{layout}' layout, try_cast({year} || '-' || p['mo'] || '-' || p['d'] || ' {clock}' as timestamp) named
      from (select *, regexp_extract(name, '^.*?{pattern}', {names!r}) p from n where regexp_matches(name, '{pattern}')) where {whole_day} true"""


_NAMED_AT = " union all ".join(_layout_sql(x) for x in N.listed(N.LAYOUTS))
add("filename_dates", on("file_names")(lambda f: N.filename_dates(_stamped(f), "1993-01-01").filter("named between timestamp_ntz'1900-01-01' and timestamp_ntz'2199-12-31'")),
    f"""with m as (select file_id, created::timestamp created, created::timestamp + case when file_id % 3 = 0 then interval '-27 hours' else interval 5 hour end modified, case when file_id % 6 = 4 then 'Foto 31-12-9' || (file_id % 10) || ' 990215_070809.png' else name end as name from {NAMES} f),
      b as (select *, case when created >= timestamp '1993-01-01' then created else modified end base0 from m), n as (select *, case when modified < base0 and modified >= timestamp '1993-01-01' then modified else base0 end base from b)
      select * from ({_NAMED_AT}) where named between timestamp '1900-01-01' and timestamp '2199-12-31'""")
add("target_path", on("file_names")(lambda f: N.target_path(f.withColumn("captured", F.col("created")), "/out", ["yyyy", "MM", "yyyyMMdd"])), f"select file_id, '/out/' || strftime(created, '%Y/%m/%Y%m%d') || lower(regexp_extract(name, '(\\.[^.]*)$', 1)) target from {NAMES} f")
add("date_shift_plan", photos(lambda p: N.date_shift_plan(p, 3600)), f"select file_id, captured, captured + interval 1 hour shifted, true changed, true writable from {P} p")
add("on_this_day", years(lambda y: ids(N.on_this_day(y, "1998-03-04"))), f"select file_id from {Y} y where month(captured) = 3 and day(captured) = 4 and year(captured) <> 1998")
_AGO = "case when {0} = 1 then '1 year ago' else {0} || ' years ago' end"
add("memory_header", years(lambda y: N.memory_header(L.memories(y, "1995-03-31"), "1995-03-31").filter("time_window <> 'Week'").select("file_id", "time_window", "header")),
    f"""with c as (select file_id, captured, year(captured) y, year(captured) // 10 * 10 d from {Y} y)
      select file_id, 'Day' time_window, 'On this day, ' || {_AGO.format('(1995 - y)')} || ' (March 31, ' || y || ')' header from c where y <> 1995 and month(captured) = 3 and day(captured) = 31
      union all select file_id, 'Month', 'This month, ' || {_AGO.format('(1995 - y)')} || ' (March 1, ' || y || ')' from c where y <> 1995 and month(captured) = 3
      union all select file_id, 'Year', 'This year (1995)' from c where y = 1995 union all select file_id, 'Decade', 'This decade, ' || {_AGO.format('(1990 - d)')} || ' (' || d || 's)' from c where d <> 1990""")
add("memories_order", years(lambda y: N.memories_order(L.memories(y, "1995-06-15").filter("time_window = 'Month'")).select("file_id", "years_ago")), f"select file_id, cast(1995 - year(captured) as int) years_ago from {Y} y where month(captured) = 6 and year(captured) <> 1995")
add("memories_filter_window", years(lambda y: L.memories(y, "1995-06-15").filter("time_window = 'Year'").select("file_id", "key")), f"select file_id, cast(1995 as int) as key from {Y} y where year(captured) = 1995")
add("path_keywords", photos(lambda p: N.path_keywords(p).select("file_id", F.array_join("words", ",").alias("words"))), f"select file_id, 'u' || user_id || ',' || event_type || ',lib' words from {P} p")
_deep = lambda p: p.withColumn("dir", F.concat(F.lit("C:/Users/2024-05/"), "event_type", F.lit("/Backup (Rome), 2023.07/Old+"), (F.col("user_id") % 3).cast("string"), F.lit("_[trip]-"), F.col("event_type")))
add("path_keywords_deep", photos(lambda p: N.path_keywords(_deep(p)).select("file_id", F.array_join("words", ",").alias("words"))), f"select file_id, 'old,trip,' || event_type || ',rome,07' words from {P} p".replace(",07'", "'"))
add("detector_fallback", photos(lambda p: p.select("file_id", F.array_join(N.detector_fallback(F.col("persons_shown"), F.col("keywords")), ",").alias("labels"))), f"select file_id, array_to_string(coalesce(persons_shown, keywords), ',') as labels from {P} p")
_tree = lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent_id"), F.concat(F.lit("K"), (F.col("p_partkey") % 50).cast("string")).alias("name"))
_PATHS = """with recursive t as (select p_partkey node_id, case when p_partkey > 1 then p_partkey // 2 end parent_id, 'K' || (p_partkey % 50) name from part),
  r as (select node_id, name, [name] path from t where parent_id is null union all select t.node_id, t.name, r.path || [t.name] from t join r on t.parent_id = r.node_id)"""
add("keyword_paths", lambda spark, sf: N.keyword_paths(_tree(spark, sf)).select("node_id", F.array_join("path", "/").alias("path")), f"{_PATHS} select node_id, array_to_string(path, '/') path from r")
add("keyword_find", lambda spark, sf: N.keyword_paths(_tree(spark, sf)).filter("lower(name) = 'k7'").select("node_id", F.array_join("path", "/").alias("path")), f"{_PATHS} select node_id, array_to_string(path, '/') path from r where lower(name) = 'k7'")
add("keyword_expand", lambda spark, sf: N.keyword_expand(relation(spark, sf, "photos"), N.keyword_paths(_tree(spark, sf))),
    f"""{_PATHS}, w as (select file_id, unnest(keywords) w from {P} p), d as (select lower(name) k, unnest(path) x from r),
      j as (select w.file_id, coalesce(d.x, w.w) x from w left join (select distinct k, x from d) d on lower(w.w) = d.k) select file_id, min(x) keyword from j group by file_id, lower(x)""")
_lines = lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("line_no"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("# "), "p_type")).otherwise(F.concat(F.lit("  "), "p_type")).alias("line"))
_WORDS = "(select lower(trim(p_type)) word, min(p_partkey) line_no from part where p_partkey % 7 <> 0 and trim(p_type) <> '' group by 1)"
add("vocabulary_clean", lambda spark, sf: N.vocabulary_clean(_lines(spark, sf)), f"select word, line_no from {_WORDS}")
add("vocabulary_hash", lambda spark, sf: N.vocabulary_hash(N.vocabulary_clean(_lines(spark, sf))), f"select substr(sha256(string_agg(word || chr(10), '' order by line_no)), 1, 16) hash from {_WORDS}")
add("calendar_grid", photos(lambda p: N.calendar_grid(p, "2024-01-01").select("day", "in_month", "n", "first_name", F.sha2(F.array_join("names", ","), 256).alias("names"))),
    f"""select d.day, month(d.day) = 1 in_month, count(p.file_id) n, min(p.name) first_name, sha256(coalesce(string_agg(p.name, ',' order by lower(p.name), p.name), '')) as names
      from (select cast(unnest(generate_series(date '2024-01-01', date '2024-02-11', interval 1 day)) as date) as day) d left join {P} p on cast(p.captured as date) = d.day group by 1""")
add("calendar_totals", photos(N.calendar_totals), f"select count(*) photos, count(distinct cast(captured as date)) as days, cast(date_trunc('month', max(captured)) as date) as month from {P} p")
add("supported_formats", on("file_names")(N.supported_formats), f"select case split_part(name, '.', 2) when 'jpg' then 'JPEG' when 'png' then 'PNG' when 'tif' then 'TIFF' else 'HEIC' end family, count(*) n from {NAMES} f group by 1")
_heads = {0: "FFD8FFE0", 1: "89504E470D0A1A0A00", 2: "49492A0008", 3: "00112233", 4: "424D0000", 5: "474946383961", 6: "524946460000000057454250", 7: "000000186674797068656963", 8: "424D00", 9: "FFD8FF00", 10: "47494638", 11: "000000186674797068656963"}
_content = lambda f: f.withColumn("content", F.unhex(F.create_map(*[F.lit(x) for kv in _heads.items() for x in kv])[(F.col("file_id") % 12).cast("int")]))
add("file_signature", on("file_names")(lambda f: N.file_signature(_content(f))),
    f"""select file_id, case when file_id % 12 in (0, 9) then 'jpg' when file_id % 12 = 1 then 'png' when file_id % 12 = 2 then 'tif' when file_id % 12 = 4 then 'bmp' when file_id % 12 = 5 then 'gif' when file_id % 12 = 6 then 'webp' when file_id % 12 in (7, 11) then 'heic' end as real,
      case when file_id % 12 in (0, 1, 2, 9, 11) then true when file_id % 12 in (4, 5, 6, 7) then false end as matches, case file_id % 12 when 4 then 'bmp' when 5 then 'gif' when 6 then 'webp' when 7 then 'heic' end suggested from {NAMES} f""")
_listing = lambda p: p.select(F.concat_ws("/", "dir", "name").alias("path"), "mtime")
add("incremental_scan", photos(lambda p: N.incremental_scan(_listing(p), _listing(p.filter("file_id % 3 > 0")).withColumn("path", F.upper("path")).withColumn("mtime", F.when(F.length("path") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + F.expr("interval 1 second")))).select("path")),
    f"select dir || '/' || name path from {P} p where file_id % 3 = 0 or length(dir || '/' || name) % 2 <> 0")
_roots = lambda p: p.select(F.col("dir").alias("root"), (F.col("user_id") % 2 == 0).alias("recursive")).distinct().unionByName(p.filter("event_type = 'click'").select(F.lit("/lib/click/").alias("root"), F.lit(True).alias("recursive")).distinct())
add("source_roots_prune", photos(lambda p: N.source_roots_prune(_roots(p)).select("root")), f"select distinct dir root from {P} p where event_type <> 'click' union all select distinct '/lib/click' from {P} p where event_type = 'click'")
add("source_root_of_file", photos(lambda p: N.source_root_of_file(p, p.select(F.when(F.col("user_id") % 2 == 0, F.col("dir")).otherwise("/lib/click").alias("root")))),
    f"select file_id, case when user_id % 2 = 0 then dir else '/lib/click' end root from {P} p where user_id % 2 = 0 or event_type = 'click'")
add("gpx_track_summary", photos(lambda p: N.first_seen_last_seen(_points(p), "user_id")), f"select user_id, min(captured) start_ts, max(captured) end_ts, count(*) n from {_TRACK} t group by 1")
add("histogram_percentile", lambda spark, sf: N.histogram_percentile(spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("bin")).agg(F.count("*").alias("n")), "l_suppkey", 0.5),
    """with h as (select l_suppkey, cast(l_quantity as int) bin, count(*) n from lineitem group by 1, 2), c as (select *, sum(n) over (partition by l_suppkey order by bin) s, sum(n) over (partition by l_suppkey) a from h)
      select l_suppkey, min(bin) bin from c where s >= greatest(1, floor(a * 0.5)) group by 1""")

# Readers: documents written from photos and read back ---------------------------------------------------------------
_gpx = lambda p: p.groupBy(F.col("user_id").alias("track_id"), F.to_date("captured").alias("day")).agg(F.array_join(F.collect_list(F.format_string('<trkpt lat="%.2f" lon="%.2f"><time>%s</time></trkpt>', "lat", "lon", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), "").alias("points")).select("track_id", F.concat(F.lit('<gpx xmlns="urn:x"><trk><trkseg><trkpt lat="1"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1" lon="2"/>'), "points", F.lit("</trkseg></trk></gpx>")).alias("xml"))
add("read_gpx", photos(lambda p: R.read_gpx(_gpx(_points(p)))), f"select user_id track_id, date_trunc('second', captured) captured, round(lat, 2) lat, round(lon, 2) lon from {_TRACK} t")
_xmp = lambda p: p.select(F.concat_ws("/", "dir", "name").alias("path"), F.concat(F.lit('<x:xmpmeta xmlns:x="x" xmlns:d="d"><d:Rating>'), F.coalesce(F.col("rating").cast("string"), F.lit("none")), F.lit("</d:Rating><d:GPSLatitude>"), geo.dms_format(F.col("lat"), "N", "S"), F.lit("</d:GPSLatitude><d:GPSLongitude>"), geo.dms_format(F.col("lon"), "E", "W"), F.lit("</d:GPSLongitude><d:subject><d:Bag>"), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("<d:li>"), k, F.lit("</d:li>"))), ""), F.lit("</d:Bag></d:subject></x:xmpmeta>")).alias("xml"))
add("read_xmp_sidecars", photos(lambda p: R.read_xmp_sidecars(_xmp(p)).select("path", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rating", F.array_join("keywords", ",").alias("keywords"))),
    f"select dir || '/' || name path, round(lat, 6) lat, round(lon, 6) lon, rating, array_to_string(keywords, ',') keywords from {P} p")
_json = lambda b: b.select(F.concat(F.lit('[{"name":"'), "name", F.lit('","lat":'), F.col("lat").cast("string"), F.lit(',"lon":'), F.col("lon").cast("string"), F.lit('},{"name":" ","lat":1,"lon":1},{"name":"far","lat":91,"lon":1}]')).alias("json")).unionByName(b.select(F.lit("not json").alias("json")))
add("read_bookmarks", on("bookmarks")(lambda b: R.read_bookmarks(_json(b)).select("name", "lat", "lon")), f"select name, lat, lon from {B} b")
add("read_people_registry", lambda spark, sf: R.read_people_registry(_faces(spark, sf).filter("name is not null").select(F.to_json(F.create_map("name", F.array("embedding"))).alias("json"))).select("name", F.col("ref_no").cast("int").alias("ref_no"), F.size("embedding").alias("dims")),
    "select 'P' || label as name, cast(0 as int) ref_no, cast(64 as int) dims from embeddings where vec_id % 4 = 0")

# Streams over the tables' files -------------------------------------------------------------------------------------
_shape = lambda name: lambda rows: shaped(rows, name)
_events = lambda sf: f"{sf}/events.parque[t]"  # a pattern: a stream takes no single file
add("stream_ingest", lambda spark, sf: T.stream_ingest(spark, _events(sf), _shape("photos"), *T.folders(spark)).select("file_id", "name"), f"select file_id, name from {P} p")
add("stream_geofence", lambda spark, sf: T.stream_geofence(spark, _events(sf), _shape("photos"), relation(spark, sf, "bookmarks"), *T.folders(spark)),
    f"select p.file_id, b.ord from {P} p, {B} b where {hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} <= b.radius_m")
Q["edit_fold"], SQL["edit_fold"] = Q["stream_edit_fold"], SQL["stream_edit_fold"]
add("stream_edit_fold", lambda spark, sf: T.stream_edit_fold(spark, _events(sf), _shape("edits"), *T.folders(spark)), SQL["edit_fold"])
def _stream_bursts(spark, sf):
    final = T.stream_bursts(spark, _events(sf), _shape("photos"), "600 seconds", *T.folders(spark))
    return final.unionByName(T.open_bursts(relation(spark, sf, "photos"), final, "600 seconds")).drop("end_ts")


add("stream_bursts", _stream_bursts,
    f"""with g as (select user_id, captured, case when epoch_us(captured) - lag(epoch_us(captured)) over (partition by user_id order by captured) <= 600000000 then 0 else 1 end cut from {P} p),
      s as (select *, sum(cut) over (partition by user_id order by captured rows unbounded preceding) k from g) select user_id, min(captured) start_ts, count(*) n from s group by user_id, k""")
