"""Photo relations derived from the supplied tables by integer arithmetic, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

K = "(event_id * 37 + user_id * 11)"
RELATIONS = {
    "photos": f"""select event_id as file_id, '/lib/' || event_type || '/u' || cast(user_id as varchar(20)) as dir,
      'IMG_' || lpad(cast(event_id as varchar(20)), 8, '0') || '.jpg' as name, ts as captured, user_id, event_type,
      case when {K} % 11 = 0 then null else cast({K} % 7 - 1 as int) end as rating,
      case {K} % 6 when 0 then 'Red' when 1 then 'Green' when 2 then 'Blue' else null end as color_label,
      cast((user_id * 7919 + event_id * 31) % 18001 as double) / cast(100 as double) - 90 as lat,
      cast((user_id * 104729 + event_id * 17) % 36001 as double) / cast(100 as double) - 180 as lon,
      'k' || cast({K} % 10 as varchar(20)) as keyword,
      split(event_type || ';k' || cast({K} % 10 as varchar(20)) || ';' || case when {K} % 13 = 0 then 'Beach' else 'beach' end, ';') as keywords,
      case when {K} % 5 = 0 then split('P' || cast(user_id % 20 as varchar(20)) || ';Q' || cast({K} % 3 as varchar(20)), ';') end as persons_shown,
      case when {K} % 3 = 0 then 'Trip ' || cast(user_id as varchar(20)) end as title,
      case when {K} % 4 = 0 then 'City' || cast(user_id % 9 as varchar(20)) when {K} % 4 = 1 then '' end as city,
      case when {K} % 2 = 0 then 'Country' || cast(user_id % 5 as varchar(20)) end as country,
      case when {K} % 7 = 0 then 'Spot' || cast(user_id % 6 as varchar(20)) when {K} % 7 = 1 then ' ' end as location, case when {K} % 3 = 1 then 'State' || cast(user_id % 4 as varchar(20)) end as state,
      case when {K} % 2 = 0 then 'Q' || cast(user_id % 5 as varchar(20)) end as country_code, case when {K} % 5 = 1 then 'On a trip, day ' || cast(event_id % 30 as varchar(20)) end as caption,
      case when {K} % 4 = 3 then 'Maker' || cast(user_id % 3 as varchar(20)) end as creator, case when {K} % 8 = 0 then 'Head ' || cast(event_id % 9 as varchar(20)) end as headline,
      ts as mtime, {K} % 17 = 0 as is_pick, {K} % 19 = 0 as is_reject from events""",
    "regions": f"""select event_id as file_id, idx,
      case when (event_id + idx) % 3 = 2 then 'dog' else 'P' || cast((user_id + idx) % 20 as varchar(20)) end as label,
      case when (event_id + idx) % 3 = 2 then 'Pet' else 'Person' end as category,
      case when (event_id * 3 + idx) % 4 = 0 then 'Proposed' else 'Accepted' end as status,
      cast((event_id * 7 + idx * 3) % 60 as double) / cast(100 as double) as x, cast((event_id * 11 + idx * 5) % 60 as double) / cast(100 as double) as y,
      cast(20 + (event_id * 13 + idx * 17) % 20 as double) / cast(100 as double) as w, cast(20 + (event_id * 5 + idx * 7) % 20 as double) / cast(100 as double) as h,
      cast((event_id * 29 + idx * 31) % 100 as double) / cast(100 as double) as score
      from events cross join (values (0), (1), (2), (3)) r(idx)""",
    "file_names": """select o_orderkey as file_id, o_orderdate as created, case o_orderkey % 6
      when 0 then 'IMG_' || strftime_(o_orderdate, 'ymd') || '_' || strftime_(o_orderdate, 'hms') || '.jpg'
      when 1 then strftime_(o_orderdate, 'y-m-d') || '-12-30-05.png'
      when 2 then 'scan ' || strftime_(o_orderdate, 'y_m_d') || '.tif'
      when 3 then 'DSC' || cast(o_orderkey as varchar(20)) || '.jpg'
      when 4 then 'x2023-13-45.jpg'
      else strftime_(o_orderdate, 'ymd') || '.heic' end as name from orders""",
    "edits": f"""select user_id as path, event_id as seq, event_type as field, {K} % 3 <> 0 as has_value,
      case when {K} % 4 = 0 then null else 'v' || cast({K} % 100 as varchar(20)) end as value from events""",
    "collection_log": f"""select event_id as seq, case when event_id % 2 = 0 then 'A' else 'a' end || cast(user_id as varchar(20)) as path,
      case when event_id % 997 = 996 then 'clear' when {K} % 3 = 0 then 'add' when {K} % 3 = 1 then 'remove' else 'toggle' end as op from events""",
    "addresses": """select c_custkey as file_id, case when c_custkey % 3 = 0 then 'Road ' || cast(c_custkey % 50 as varchar(20)) when c_custkey % 3 = 1 then ' ' end as road,
      case when c_custkey % 5 < 3 then 'Path ' || cast(c_custkey % 7 as varchar(20)) end as pedestrian, cast(null as varchar(20)) as path, '' as neighbourhood,
      case when c_custkey % 4 = 0 then 'Suburb' end as suburb, case when c_custkey % 4 < 2 then cast(c_custkey % 90 as varchar(20)) when c_custkey % 4 = 2 then '' end as house_number,
      case when c_custkey % 6 = 0 then c_mktsegment end as city, case when c_custkey % 6 < 3 then 'Town' else '' end as town, 'Village' as village, 'Hamlet' as hamlet, 'Municipality' as municipality,
      case when c_custkey % 7 = 0 then 'State' end as state, case when c_custkey % 7 < 4 then 'Region' end as region, case when c_custkey % 2 = 0 then 'County' end as county,
      'Country ' || cast(c_nationkey as varchar(20)) as country, case c_custkey % 8 when 0 then 'us' when 1 then 'gb' when 2 then 'de' when 3 then 'ca' when 4 then '' when 5 then 'fr' when 6 then 'Ie' end as country_code from customer""",
    "develop": f"""select event_id as file_id, user_id, case when {K} % 3 = 0 then cast({K} % 5 as double) end as exposure, cast({K} % 2 as double) as contrast, cast(0 as double) as shadows,
      cast(-({K} % 4) as double) as tint, {K} % 4 * 90 as rotation, case when {K} % 6 = 0 then cast(0.25 as double) else cast(0 as double) end as crop_left,
      case when {K} % 9 = 0 then cast(0.5 as double) else cast(1 as double) end as crop_right, {K} % 3 as upscale, case when {K} % 5 = 0 then 'Warm' when {K} % 5 = 1 then '' end as look_name,
      cast({K} % 2 as double) as look_opacity, {K} % 3 as local_adjustments from events""",
    "attempts": f"""select event_id as seq, user_id % 50 as path, event_type as field, {K} % 12 <> 0 as failed from events""",
    "hashes": """select vec_id as file_id, label * 1000 + (vec_id % 7) * (vec_id % 11) as hash from embeddings""",
    "candidates": """select l_orderkey as file_id, l_linenumber as n, l_shipdate as ts, case l_linenumber % 6 when 0 then 'Gps' when 1 then 'SubIfd'
      when 2 then 'Ifd0' when 3 then 'FileName' when 4 then 'Modified' else 'Created' end as source from lineitem where l_partkey % 3 > 0""",
    "photos_years": "select o_orderkey as file_id, o_orderdate as captured, o_custkey % 50 as person from orders",
    "bookmarks": """select s_suppkey as ord, s_name as name, cast((s_suppkey * 3571) % 16001 as double) / cast(100 as double) - 80 as lat,
      cast((s_suppkey * 7127) % 36001 as double) / cast(100 as double) - 180 as lon, cast(500 + (s_suppkey * 991) % 49500 as double) as radius_m from supplier""",
}
_STAMPS = {"ymd": ("yyyyMMdd", "%Y%m%d"), "hms": ("HHmmss", "%H%M%S"), "y-m-d": ("yyyy-MM-dd", "%Y-%m-%d"), "y_m_d": ("yyyy_MM_dd", "%Y_%m_%d")}
BASE = {"addresses": "customer", "develop": "events", "attempts": "events", "regions": "events", "file_names": "orders", "edits": "events", "collection_log": "events", "hashes": "embeddings", "candidates": "lineitem", "photos": "events", "photos_years": "orders", "bookmarks": "supplier"}


def _stamped(text: str, side: int) -> str:
    """strftime_(column, name) as the date function of Spark (side 0) or DuckDB (side 1)."""
    for name, forms in _STAMPS.items():
        text = re.sub(rf"strftime_\((\w+), '{name}'\)", rf"{('date_format', 'strftime')[side]}(\1, '{forms[side]}')", text)
    return text


def shaped(base: DataFrame, name: str) -> DataFrame:
    """The relation over its base table's rows, which may be a stream."""
    text = _stamped(RELATIONS[name], 0).replace(f"from {BASE[name]}", f"from {{{BASE[name]}}}")
    return base.sparkSession.sql(text, **{BASE[name]: base})


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shaped(spark.read.parquet(f"{sf_dir}/{BASE[name]}.parquet"), name)


def oracle_from(name: str) -> str:
    return f"({_stamped(RELATIONS[name], 1)})"
