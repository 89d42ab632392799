"""Registered queries of region edits, names, metadata sources, light, files and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import files as X
from ..operators import tagging as T
from ..sources.relations import oracle_from, relation

P, REG, ADDR, DEV, ATT = (oracle_from(x) for x in ("photos", "regions", "addresses", "develop", "attempts"))
Q, SQL = {}, {}


def add(name, fn, *names, sql=None):
    """fn takes the relations named."""
    Q[name] = lambda spark, sf: fn(*[relation(spark, sf, n) for n in names])
    if sql:
        SQL[name] = sql


# Region edits: one command a photo, a third of them past the end ---------------------------------------------------
_commands = lambda r: r.filter("idx = 0").select("file_id", (F.col("file_id") % 6).cast("int").alias("idx"), F.concat(F.lit("P"), (F.col("file_id") % 20).cast("string")).alias("label"))
_CMD = f"(select file_id, cast(file_id % 6 as int) idx, 'P' || cast(file_id % 20 as varchar) as label from {REG} c where idx = 0)"
add("command_errors", lambda r: T.command_errors(r, _commands(r)).select("file_id", "idx"), "regions", sql=f"select file_id, idx from {_CMD} x where idx > 3")
add("region_accept", lambda r: T.region_accept(r, _commands(r)).select("file_id", "idx", "status"), "regions",
    sql=f"select r.file_id, r.idx, case when c.idx is null then r.status else 'Accepted' end status from {REG} r left join {_CMD} c on c.file_id = r.file_id and c.idx = r.idx")
add("region_discard", lambda r: T.region_discard(r, _commands(r)).select("file_id", "idx", "label"), "regions",
    sql=f"select file_id, cast(row_number() over (partition by file_id order by idx) - 1 as int) idx, label from {REG} r where idx <> file_id % 6")
add("region_relabel", lambda r: T.region_relabel(r, _commands(r)).select("file_id", "idx", "label"), "regions",
    sql=f"""select r.file_id, r.idx, case when c.idx > 3 then r.label when c.idx = r.idx then c.label when r.category = 'Person' and lower(r.label) = lower(c.label) then null else r.label end as label
      from {REG} r join {_CMD} c on c.file_id = r.file_id""")
_shifted = lambda r: r.filter("idx % 2 = 1").withColumn("x", F.col("x") + F.col("file_id") % 2)
add("region_append", lambda r: T.region_append(r, _shifted(r)).select("file_id", "idx", "label"), "regions",
    sql=f"""with b as (select 0 part, * from {REG} r union all by name select 1 part, * replace (x + file_id % 2 as x) from {REG} s where idx % 2 = 1),
      n as (select *, row_number() over (partition by file_id, round(x, 3), round(y, 3), round(w, 3), round(h, 3), category order by part, idx) k from b)
      select file_id, cast(row_number() over (partition by file_id order by part, idx) - 1 as int) idx, label from n where k = 1""")
add("tag_face", lambda r: T.tag_face(r, _commands(r)).select("file_id", "idx", "label"), "regions",
    sql=f"""with f as (select *, row_number() over (partition by file_id order by idx) - 1 nth from {REG} r where category = 'Person' and status = 'Accepted'),
      g as (select f.*, c.label as name from f join {_CMD} c on c.file_id = f.file_id and c.idx = f.nth)
      select r.file_id, r.idx, case when r.category = 'Person' and r.status = 'Accepted' and r.x = g.x and r.y = g.y and r.w = g.w and r.h = g.h then g.name
        when r.category = 'Person' and lower(r.label) = lower(g.name) then null else r.label end as label from {REG} r left join g on g.file_id = r.file_id""")
add("promote_labels", lambda p, r: T.promote_labels(p, r.filter("idx = file_id % 6")).select("file_id", F.array_join("keywords", ",").alias("words")), "photos", "regions",
    sql=f"select p.file_id, array_to_string(p.keywords || case when r.label is null then [] else [r.label] end, ',') words from {P} p left join {REG} r on r.file_id = p.file_id and r.idx = p.file_id % 6")
add("face_assign_names", lambda r: T.face_assign_names(r.filter("status = 'Accepted'"), r.filter("status = 'Proposed' and category = 'Person'").select("file_id", "idx", F.concat(F.lit("p"), (F.col("idx") % 2 + F.col("file_id") % 20).cast("string")).alias("name"), F.col("score").alias("similarity"))), "regions",
    sql=f"""with m as (select file_id, idx, 'p' || cast(idx % 2 + file_id % 20 as varchar) as name, score from {REG} r where status = 'Proposed' and category = 'Person'),
      k as (select *, row_number() over (partition by file_id, name order by score desc, idx) rank from m)
      select file_id, idx, name from k where rank = 1 and not exists (select 1 from {REG} t where t.file_id = k.file_id and t.status = 'Accepted' and t.category = 'Person' and lower(t.label) = k.name)""")

# Clusters of faces -------------------------------------------------------------------------------------------------
_members = lambda r: r.select(((F.col("file_id") * 31 + F.col("idx") * 7) % 40).alias("cluster_id"), "file_id", "idx", F.when((F.col("file_id") * 31 + F.col("idx") * 7) % 40 % 3 == 0, F.col("label")).alias("label"))
_names = lambda r: _members(r).filter("cluster_id % 4 = 0").select("cluster_id", F.concat(F.lit("Name"), F.col("cluster_id").cast("string")).alias("name")).distinct()
_chosen = lambda r: _members(r).filter("cluster_id % 5 > 0").select(F.floor(F.col("cluster_id") / 4).alias("merge_id"), (-F.col("cluster_id")).alias("ord"), "cluster_id").distinct()
_MEM = f"(select (file_id * 31 + idx * 7) % 40 as cluster_id, file_id, idx, case when (file_id * 31 + idx * 7) % 40 % 3 = 0 then label end as label from {REG} r)"
add("apply_cluster_name", lambda r: T.apply_cluster_name(_members(r), _names(r)).select("cluster_id", "file_id", "idx", "label"), "regions",
    sql=f"select cluster_id, file_id, idx, case when cluster_id % 4 = 0 then 'Name' || cast(cluster_id as varchar) else label end as label from {_MEM} m")
add("name_cluster", lambda r: T.name_cluster(r, _members(r).drop("label"), _names(r)).select("file_id", "idx", "label", "status"), "regions",
    sql=f"""select r.file_id, r.idx, case when m.cluster_id % 4 = 0 then 'Name' || cast(m.cluster_id as varchar) else r.label end as label, case when m.cluster_id % 4 = 0 then 'Accepted' else r.status end as status
      from {REG} r join {_MEM} m on m.file_id = r.file_id and m.idx = r.idx""")
add("merge_clusters", lambda r: T.merge_clusters(_members(r), _chosen(r)).select("cluster_id", "file_id", "idx", "label"), "regions",
    sql=f"""with m as (select * from {_MEM} q), c as (select cluster_id, arg_min(label, file_id * 10 + idx) filter (label is not null) shown from m where cluster_id % 5 > 0 group by 1),
      g as (select cluster_id // 4 merge_id, max(cluster_id) target, arg_max(shown, cluster_id) filter (shown is not null) name, count(*) n from c group by 1)
      select case when n > 1 then target else m.cluster_id end as cluster_id, file_id, idx, case when n > 1 then coalesce(name, m.label) else m.label end as label
      from m left join g on m.cluster_id % 5 > 0 and g.merge_id = m.cluster_id // 4""")

# Metadata of photos ------------------------------------------------------------------------------------------------
_flagged = lambda p: p.withColumns({"blurry": F.col("file_id") % 3 == 0, "overexposed": F.col("file_id") % 4 == 0, "underexposed": F.when(F.col("file_id") % 5 > 0, F.col("file_id") % 2 == 0)})
_FLAG = f"(select *, file_id % 3 = 0 blurry, file_id % 4 = 0 overexposed, file_id % 5 > 0 and file_id % 2 = 0 underexposed from {P} p)"
add("quality_tags", lambda p: T.quality_tags(_flagged(p)).select("file_id", F.array_join("keywords", ",").alias("words")), "photos",
    sql=f"select file_id, array_to_string(keywords, ',') || case when blurry then ',qa:blurry' else '' end || case when overexposed then ',qa:overexposed' else '' end || case when underexposed then ',qa:underexposed' else '' end words from {_FLAG} f")
add("quality_summary", lambda p: T.quality_summary(_flagged(p)), "photos", sql=f"select count(*) filter (blurry or overexposed or underexposed) flagged, count(*) total from {_FLAG} f")


def _sources(p):
    def part(where, **cols):
        return p.filter(where).select(F.col("file_id").alias("path"), *[c.alias(k) for k, c in cols.items()])

    none = F.array().cast("array<string>")
    return {"sidecar": part("file_id % 5 = 0", title=F.when(F.col("file_id") % 2 == 0, F.lit("side")), keywords=F.when(F.col("file_id") % 10 == 0, F.array("keyword")).otherwise(none)),
            "xmp": part("file_id % 2 = 0", title=F.lit("xmp"), city=F.col("city"), keywords=none), "exif": part("file_id % 7 > 0", title=F.col("title"), rating=F.col("rating")),
            "iptc": part("file_id % 3 > 0", title=F.lit("iptc"), city=F.lit("Rome"), rating=F.lit(9), keywords=F.col("keywords"))}


add("metadata_precedence_merge", lambda p: T.metadata_precedence_merge(_sources(p), ["title", "city", "rating"], ["keywords"]).withColumn("keywords", F.array_join("keywords", ",")), "photos",
    sql=f"""select file_id path, case when file_id % 10 = 0 then 'side' when file_id % 2 = 0 then 'xmp' when file_id % 7 > 0 and title is not null then title when file_id % 3 > 0 then 'iptc' end title,
      case when file_id % 2 = 0 and city is not null then city when file_id % 3 > 0 then 'Rome' end city, case when file_id % 7 > 0 and rating is not null then rating when file_id % 3 > 0 then 9 end rating,
      case when file_id % 10 = 0 then keyword when file_id % 3 > 0 then array_to_string(keywords, ',') else '' end keywords
      from {P} p where file_id % 5 = 0 or file_id % 2 = 0 or file_id % 7 > 0 or file_id % 3 > 0""")
_some = lambda cols: "coalesce(" + ", ".join(f"case when trim({c}) <> '' then {c} end" for c in cols) + ")"
add("address_normalise", lambda a: T.address_normalise(a).select("file_id", "location", "city", "state", "country", "country_code"), "addresses",
    sql=f"""with s as (select *, {_some(T.STREET)} street, upper(nullif(country_code, '')) code from {ADDR} a)
      select file_id, case when street is null or trim(coalesce(house_number, '')) = '' then street when code in ('US', 'GB', 'CA', 'AU', 'NZ', 'IE') then house_number || ' ' || street else street || ' ' || house_number end as location,
      {_some(T.CITY)} city, {_some(T.STATE)} state, country, code country_code from s""")
add("applied_edits_count", lambda d: T.applied_edits_count(d).groupBy("user_id").agg(F.sum("edits").alias("edits"), F.count_if(F.col("edits") > 0).alias("edited")), "develop",
    sql=f"""with c as (select user_id, cast(coalesce(exposure, 0) <> 0 as int) + cast(contrast <> 0 as int) + cast(tint <> 0 as int) + cast(rotation <> 0 as int) + cast(crop_left > 0 or crop_right < 1 as int)
      + cast(upscale > 1 as int) + cast(coalesce(look_name, '') <> '' and look_opacity > 0 as int) + local_adjustments edits from {DEV} d)
      select user_id, cast(sum(edits) as bigint) edits, count(*) filter (edits > 0) edited from c group by 1""")
add("edit_retry", T.edit_retry, "attempts",
    sql=f"""with a as (select *, max(seq) filter (not failed) over (partition by path, field) ok from {ATT} a)
      select path, field, count(*) attempts, case when count(*) >= 10 then 'dead' else 'pending' end state from a where ok is null or seq > ok group by 1, 2""")

# Light -------------------------------------------------------------------------------------------------------------
_UP = "degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin({0}_dec) + cos(radians(lat)) * cos({0}_dec) * cos(radians(turn + lon) - {0}_ra)))))"
_MOON = " + ".join(f"({a}) * sin(radians({b} + ({c}) * d / 36525))" for a, b, c in sky.MOON_LONGITUDE)
_MOON_UP = " + ".join(f"({a}) * sin(radians({b} + ({c}) * d / 36525))" for a, b, c in sky.MOON_LATITUDE)
_SKY = f"""with t as (select file_id, lat, lon, (floor(epoch(captured)) - 946728000) / 86400.0 d from {P} p),
  u as (select *, radians(23.439 - 0.0000004 * d) tilt, 280.46061837 + 360.98564736629 * d + pow(d / 36525, 2) * (0.000387933 - d / 36525 / 38710000) turn, radians(357.528 + 0.9856003 * d) g,
    radians(218.32 + 481267.8813 * d / 36525 + {_MOON}) ml, radians({_MOON_UP}) mb from t),
  v as (select *, radians(280.460 + 0.9856474 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) sl from u),
  w as (select *, asin(sin(tilt) * sin(sl)) sun_dec, atan2(cos(tilt) * sin(sl), cos(sl)) sun_ra, asin(sin(mb) * cos(tilt) + cos(mb) * sin(tilt) * sin(ml)) moon_dec,
    atan2(sin(ml) * cos(tilt) - tan(mb) * sin(tilt), cos(ml)) moon_ra from v),
  r as (select file_id, {_UP.format('sun')} sun, {_UP.format('moon')} moon from w),
  k as (select *, case when sun > 6 then 'Daylight' when sun > 0 then 'Golden' when sun > -6 then 'Blue' when sun > -12 then 'Nautical' when sun > -18 then 'Astronomical' else 'Night' end light from r)"""


def _light(p):
    sun, moon = (f(F.col("captured"), F.col("lat"), F.col("lon"))[1] for f in (sky.sun_position, sky.moon_position))
    return p.select("file_id", sun.alias("sun"), moon.alias("moon")).withColumn("light", sky.twilight(F.col("sun")))


add("photo_light", lambda p: _light(p).withColumns({"sun": F.round("sun", 3), "moon": F.round("moon", 3)}), "photos", sql=f"{_SKY} select file_id, round(sun, 3) sun, round(moon, 3) moon, light from k")
add("photo_light_report", lambda p: _light(p).groupBy("light").agg(F.count("*").alias("n")), "photos", sql=f"{_SKY} select light, count(*) n from k group by 1")

# Files and clusters ------------------------------------------------------------------------------------------------
add("write_table", X.write_by_year, "photos_years", sql=f"select cast(year(captured) as int) as year, count(*) n from {oracle_from('photos_years')} p group by 1")
add("geo_kmeans", lambda p: X.geo_kmeans(p, 12).select("file_id", "cluster"), "photos")
Q["scan_files"] = lambda spark, sf: X.scan_files(spark, sf, ["PARQUET"]).select("name", "length")
