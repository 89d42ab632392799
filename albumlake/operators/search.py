"""Search over photos: one row per photo, with keywords and persons_shown arrays; regions are rows of their own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library import PLACES, contains_ci


def blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) == ""


def any_text_haystack(photos: DataFrame, regions: DataFrame) -> DataFrame:
    """photos plus haystack: title, caption, places, keywords and the labels of the photo's regions."""
    labels = regions.groupBy("file_id").agg(F.collect_list("label").alias("labels"))
    parts = F.concat(F.array("title", "caption", *PLACES), F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("labels", F.array().cast("array<string>")))
    return photos.join(labels, "file_id", "left").withColumn("haystack", F.array_compact(parts))


def library_search(photos: DataFrame, regions: DataFrame, any_text: str = "", keyword: str = "", person: str = "", location: str = "", min_rating: int | None = None, color_label: str = "") -> DataFrame:
    """Photos that meet every field given, newest first; no field given finds all. A person is the label of a Person region."""
    out = any_text_haystack(photos, regions) if any_text.strip() else photos
    if any_text.strip():
        out = out.filter(F.exists("haystack", lambda x: contains_ci(x, any_text))).drop("haystack", "labels")
    if keyword.strip():
        out = out.filter(F.exists("keywords", lambda x: contains_ci(x, keyword)))
    if person.strip():
        shown = regions.filter((F.col("category") == "Person") & contains_ci(F.col("label"), person)).select("file_id").distinct()
        out = out.join(shown, "file_id", "left_semi")
    if location.strip():
        out = out.filter(F.exists(F.array_compact(F.array(*PLACES)), lambda x: contains_ci(x, location)))
    if min_rating is not None:
        out = out.filter(F.coalesce("rating", F.lit(0)) >= min_rating)
    if color_label.strip():
        out = out.filter(F.lower("color_label") == color_label.lower())
    return newest_first(out)


def newest_first(photos: DataFrame) -> DataFrame:
    return photos.orderBy(F.desc("mtime"), "dir", "name")


def search_index(photos: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """photos plus the lower-cased text that grid_filter looks through: name, folder, path, texts, places, maker, keywords,
    persons and the labels of the photo's regions in order; blank parts are left out."""
    none = F.array().cast("array<string>")
    labels = none
    if regions is not None:
        of = regions.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda r: r["label"]).alias("_labels"))
        photos, labels = photos.join(of, "file_id", "left"), F.coalesce("_labels", none)
    single = F.array("name", "dir", F.concat_ws("/", "dir", "name"), "title", "caption", *PLACES, "creator", "headline")
    parts = F.concat(single, F.coalesce("keywords", none), F.coalesce("persons_shown", none), labels)
    return photos.withColumn("search_text", F.lower(F.array_join(F.filter(F.array_compact(parts), lambda x: ~blank(x)), " ")))


def pick_mode(mode: str) -> Column:
    """ShowAll, HideRejects, PicksOnly or RejectsOnly on the two flags; a missing flag is not set."""
    pick, reject = F.coalesce("is_pick", F.lit(False)), F.coalesce("is_reject", F.lit(False))
    return {"ShowAll": F.lit(True), "HideRejects": ~reject, "PicksOnly": pick, "RejectsOnly": reject}[mode]


def pick_reject_filter(photos: DataFrame, mode: str) -> DataFrame:
    return photos.filter(pick_mode(mode))


def grid_filter(photos: DataFrame, text: str = "", stars: int = 0, label: str = "", mode: str = "ShowAll", day: str | None = None, collection: DataFrame | None = None) -> DataFrame:
    """Photos whose search text has every word of `text`, with the other limits; `day` is one whole day."""
    out = search_index(photos)
    for token in text.lower().split():
        out = out.filter(F.contains("search_text", F.lit(token)))
    if stars:
        out = out.filter(F.coalesce("rating", F.lit(0)) >= stars)
    if label:
        out = out.filter(F.lower("color_label") == label.lower())
    if day:
        out = timeline_drill(out, day, "1 day")
    if collection is not None:
        out = selection_semi(out, collection)
    return out.filter(pick_mode(mode)).drop("search_text")


def timeline_drill(photos: DataFrame, start: str, length: str) -> DataFrame:
    """Photos of one bucket: from its start to before its end."""
    at = F.lit(start).cast("timestamp_ntz")
    return photos.filter((F.col("captured") >= at) & (F.col("captured") < at + F.expr(f"interval {length}")))


def selection_semi(photos: DataFrame, collection: DataFrame) -> DataFrame:
    """Photos whose dir/name is a path of the collection, without regard to case."""
    keys = collection.select(F.lower("path").alias("_path")).distinct()
    return photos.withColumn("_path", F.lower(F.concat_ws("/", "dir", "name"))).join(keys, "_path", "left_semi").drop("_path")


def distinct_labels(values: DataFrame, col: str) -> DataFrame:
    """Values of a column, distinct without regard to case, each in its least spelling; blanks left out."""
    return values.filter(~blank(F.col(col))).groupBy(F.lower(col).alias("key")).agg(F.min(col).alias(col), F.count("*").alias("n"))


def distinct_keywords(photos: DataFrame) -> DataFrame:
    return distinct_labels(photos.select(F.explode("keywords").alias("keyword")), "keyword")


def distinct_people(regions: DataFrame) -> DataFrame:
    return distinct_labels(regions.filter("category = 'Person'").select(F.col("label").alias("person")), "person")


def distinct_locations(photos: DataFrame) -> DataFrame:
    return distinct_labels(photos.select(F.explode(F.array(*PLACES[:4])).alias("place")), "place")


def looks_equirectangular(images: DataFrame) -> DataFrame:
    """images (keywords, width, height) plus a flag: named so, or about 2:1, or wide with at least 1.7:1."""
    named = F.coalesce(F.exists("keywords", lambda x: contains_ci(x, "equirectangular")), F.lit(False))
    aspect = F.col("width") / F.col("height")
    shape = (F.abs(aspect - 2.0) <= 0.1) | ((F.col("width") >= 4096) & (aspect >= 1.7))
    return images.withColumn("equirectangular", named | F.coalesce(shape, F.lit(False)))
