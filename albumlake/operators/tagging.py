"""Edits of regions and names, over tables: a region row has file_id, idx, label, category, status, x, y, w, h; a command row
has file_id, idx and what it sets. Commands without such a region change nothing; command_errors lists them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .faces import dedupe_regions, effective_faces
from .ordered import merge_keywords

KEY = ["file_id", "idx"]
#: Regions that one task sorts.
ROWS_A_TASK = 500_000


def _renumbered(regions: DataFrame, *order: str) -> DataFrame:
    return regions.withColumn("idx", (F.row_number().over(Window.partitionBy("file_id").orderBy(*order)) - 1).cast("int"))


def command_errors(regions: DataFrame, commands: DataFrame) -> DataFrame:
    return commands.join(regions.select(*KEY), KEY, "left_anti")


def region_append(regions: DataFrame, new: DataFrame) -> DataFrame:
    """New regions after those of the photo; of equal boxes of a category the first stays; numbered from 0 again."""
    both = regions.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    # A task sorts all that it holds, so tasks grow in number with the rows, not in size.
    least = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(max(least, -(-both.count() // ROWS_A_TASK)), "file_id")
    return _renumbered(dedupe_regions(_renumbered(both, "_part", "idx").drop("_part")), "idx")


def region_accept(regions: DataFrame, commands: DataFrame) -> DataFrame:
    hit = commands.select(*KEY, F.lit(True).alias("_hit")).distinct()
    return regions.join(hit, KEY, "left").withColumn("status", F.when(F.col("_hit"), "Accepted").otherwise(F.col("status"))).drop("_hit")


def region_discard(regions: DataFrame, commands: DataFrame) -> DataFrame:
    """Without the regions named; the rest numbered from 0 again. Keywords stay."""
    return _renumbered(regions.join(commands.select(*KEY), KEY, "left_anti"), "idx")


def _named(regions: DataFrame, owner: Column, name: Column) -> DataFrame:
    """The owner takes the name, and other Person regions of that name in the photo lose it."""
    twin = (F.col("category") == "Person") & (F.lower("label") == F.lower(name))
    return regions.withColumn("label", F.when(owner, name).when(twin, F.lit(None)).otherwise(F.col("label")))


def region_relabel(regions: DataFrame, commands: DataFrame) -> DataFrame:
    """One command (file_id, idx, label) a photo."""
    good = commands.join(regions.select(*KEY), KEY, "left_semi").select("file_id", F.col("idx").alias("_at"), F.col("label").alias("_name"))
    return _named(regions.join(good, "file_id", "left"), F.col("idx") == F.col("_at"), F.col("_name")).drop("_at", "_name")


def tag_face(regions: DataFrame, commands: DataFrame) -> DataFrame:
    """One command (file_id, idx, label) a photo, idx counting its accepted Person regions from 0; accepted Person regions
    of that face's box take the name."""
    faces = _renumbered(effective_faces(regions), "idx").select(*KEY, *[F.col(c).alias(f"_{c}") for c in "xywh"])
    good = commands.join(faces, KEY).select("file_id", F.col("label").alias("_name"), *[f"_{c}" for c in "xywh"])
    owner = (F.col("category") == "Person") & (F.col("status") == "Accepted")
    for c in "xywh":
        owner &= F.col(c) == F.col(f"_{c}")
    return _named(regions.join(good, "file_id", "left"), owner, F.col("_name")).drop("_name", *[f"_{c}" for c in "xywh"])


def promote_labels(photos: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labels of these regions, in order of idx, join the photo's keywords."""
    words = labelled.filter(F.trim("label") != "").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda s: s["label"]).alias("_labels"))
    merged = F.when(F.col("_labels").isNull(), F.col("keywords")).otherwise(merge_keywords(F.col("keywords"), F.col("_labels")))
    return photos.join(words, "file_id", "left").withColumn("keywords", merged).drop("_labels")


def face_assign_names(regions: DataFrame, matches: DataFrame) -> DataFrame:
    """(file_id, idx, name) of the matches (file_id, idx, name, similarity; one a face) that get their name: in each photo
    a name goes to the most similar face, and to none if a Person region has it. One match a face makes the claims of
    different names independent, so a rank per name equals claiming in order of similarity."""
    taken = regions.filter((F.col("category") == "Person") & (F.trim("label") != "")).select("file_id", F.lower("label").alias("_key")).distinct()
    keyed = matches.withColumn("_key", F.lower("name"))
    best = Window.partitionBy("file_id", "_key").orderBy(F.desc("similarity"), "idx")
    return keyed.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").join(taken, ["file_id", "_key"], "left_anti").select(*KEY, "name")


def apply_cluster_name(members: DataFrame, names: DataFrame) -> DataFrame:
    """members (cluster_id, ...) with the label of names (cluster_id, name); clusters without a name keep theirs."""
    return members.join(names, "cluster_id", "left").withColumn("label", F.coalesce("name", "label")).drop("name")


def name_cluster(regions: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """The regions of members (cluster_id, file_id, idx) of a named cluster take the name and become accepted."""
    hit = members.join(names.filter(F.trim("name") != ""), "cluster_id").select(*KEY, "name")
    out = regions.join(hit, KEY, "left")
    return out.withColumns({"label": F.coalesce("name", "label"), "status": F.when(F.col("name").isNotNull(), "Accepted").otherwise(F.col("status"))}).drop("name")


def merge_clusters(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """members (cluster_id, file_id, idx, label) with the chosen clusters (merge_id, ord, cluster_id) of each merge as one:
    its first one's id, and the label of the first that has one. A cluster chosen alone stays."""
    has = F.trim(F.coalesce("label", F.lit(""))) != ""
    shown = members.groupBy("cluster_id").agg(F.min_by("label", F.when(has, F.struct("file_id", "idx"))).alias("_shown"))
    picks = chosen.join(shown, "cluster_id")
    into = picks.groupBy("merge_id").agg(F.min_by("cluster_id", "ord").alias("_into"), F.min_by("_shown", F.when(F.col("_shown").isNotNull(), F.col("ord"))).alias("_name"), F.count("*").alias("_n"))
    moved = picks.join(into.filter("_n > 1"), "merge_id").select("cluster_id", "_into", "_name")
    out = members.join(moved, "cluster_id", "left").withColumns({"label": F.coalesce("_name", "label"), "cluster_id": F.coalesce("_into", "cluster_id")})
    return out.drop("_into", "_name")


def quality_tags(photos: DataFrame) -> DataFrame:
    """keywords of photos (blurry, overexposed, underexposed) with a tag for each flag that is set."""
    tags = F.array_compact(F.array(*[F.when(F.col(c), f"qa:{c}") for c in ("blurry", "overexposed", "underexposed")]))
    return photos.withColumn("keywords", F.when(F.size(tags) > 0, merge_keywords(F.col("keywords"), tags)).otherwise(F.col("keywords")))


def quality_summary(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count_if(F.coalesce("blurry", F.lit(False)) | F.coalesce("overexposed", F.lit(False)) | F.coalesce("underexposed", F.lit(False))).alias("flagged"), F.count("*").alias("total"))


def metadata_precedence_merge(sources: dict[str, DataFrame], scalars: list[str], lists: list[str]) -> DataFrame:
    """One row per path of sources (sidecar, xmp, exif, iptc: strongest first), each (path, columns; one row a path). A
    scalar is the strongest that is not null, a list the strongest that is not empty. The sources are stacked, so there is
    one shuffle and no chain of outer joins; columns that a source lacks count as null."""
    rows = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(sources[s] for s in ("sidecar", "xmp", "exif", "iptc") if s in sources)]
    stacked = rows[0]
    for df in rows[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    rank = F.col("_rank")
    picked = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in scalars]
    picked += [F.coalesce(F.min_by(c, F.when(F.size(c) > 0, rank)), F.array().cast("array<string>")).alias(c) for c in lists]
    return stacked.groupBy("path").agg(*picked)


def iptc_date(date: Column, time: Column) -> Column:
    """IPTC's yyyyMMdd and HHmmss, with or without a zone, as one local time; without a time midnight, unreadable null."""
    text = F.concat(date, F.substring(F.coalesce(time, F.lit("000000")), 1, 6))
    return F.when(F.trim(date) != "", F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


#: Countries that write the house number before the street.
NUMBER_FIRST = ["US", "GB", "CA", "AU", "NZ", "IE"]
STREET = ["road", "pedestrian", "path", "neighbourhood", "suburb"]
CITY = ["city", "town", "village", "hamlet", "municipality"]
STATE = ["state", "region", "county"]


def address_normalise(found: DataFrame) -> DataFrame:
    """location, city, state, country and country_code beside a geocoder's address columns."""
    def first(names: list[str]) -> Column:
        return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in names])

    code = F.when(F.col("country_code") != "", F.upper("country_code"))
    number, street = F.col("house_number"), first(STREET)
    full = F.when(F.coalesce(F.trim(number), F.lit("")) == "", street).when(F.coalesce(code.isin(NUMBER_FIRST), F.lit(False)), F.concat_ws(" ", number, street)).otherwise(F.concat_ws(" ", street, number))
    return found.withColumns({"location": F.when(street.isNotNull(), full), "city": first(CITY), "state": first(STATE), "country_code": code})


#: Develop settings that count once each when away from zero.
KNOBS = ["exposure", "contrast", "highlights", "shadows", "whites", "blacks", "clarity", "vibrance", "saturation", "temperature", "tint",
         "red_gain", "green_gain", "blue_gain", "crop_angle"]
LEAST = 1e-6


def applied_edits_count(settings: DataFrame) -> DataFrame:
    """settings plus edits: how many settings differ from the default. A null or missing column is the default."""
    def col(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in settings.columns else F.lit(default)

    tests = [F.abs(col(k, 0.0)) > LEAST for k in KNOBS]
    tests.append(col("rotation", 0.0) != 0)
    tests.append((col("crop_left", 0.0) > LEAST) | (col("crop_top", 0.0) > LEAST) | (col("crop_right", 1.0) < 1 - LEAST) | (col("crop_bottom", 1.0) < 1 - LEAST))
    tests += [col("denoise", 0.0) > LEAST, col("upscale", 1.0) > 1, col("colorize", 0.0) > LEAST]
    if "look_name" in settings.columns:
        tests.append((F.coalesce("look_name", F.lit("")) != "") & (col("look_opacity", 0.0) > LEAST))
    total = sum((t.cast("int") for t in tests), F.lit(0)) + col("local_adjustments", 0.0).cast("int")
    return settings.withColumn("edits", total)


def edit_retry(attempts: DataFrame, most: int = 10) -> DataFrame:
    """Of attempts (path, field, seq, failed), the edits whose last attempt failed: failures since the last success, and
    whether they are a dead letter (`most` or more) or pending."""
    last = attempts.groupBy("path", "field").agg(F.max(F.when(~F.col("failed"), F.col("seq"))).alias("_ok"))
    after = attempts.join(last, ["path", "field"]).filter(F.col("_ok").isNull() | (F.col("seq") > F.col("_ok")))
    n = F.count("*")
    return after.groupBy("path", "field").agg(n.alias("attempts"), F.when(n >= most, "dead").otherwise("pending").alias("state"))
