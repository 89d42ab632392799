"""Dates in names, target paths, folder keywords, keyword trees, calendars, formats and roots."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

# Extensions by format family.
FORMATS_TEXT = """
JPEG: jpg jpeg jfif jpe | TIFF: tiff tif | Photoshop: psd psb | PNG: png | APNG: apng | BMP: bmp dib | GIF: gif | ICO: ico |
Netpbm: pgm ppm pbm pnm | PCX: pcx | WebP: webp | HEIC: heic heif | AVIF: avif | JPEG 2000: jp2 j2k jpc | HDR: hdr | OpenEXR: exr |
DDS: dds | QuickTime: mov mp4 m4v 3gp 3g2 |
RAW: cr2 cr3 crw nef arw srf sr2 ari sraw dng raw raf orf rw2 pef ptx pxn srw x3f mrw mdc dcr kdc dcs dc2 k25 erf mef mos r3d rwl rwz
  iiq cap 3fr fff bay ciff cs1 drf
"""
FORMATS = {family.strip(): exts.split() for family, _, exts in (part.partition(":") for part in FORMATS_TEXT.split("|"))}
# First bytes of formats (a pattern over hex digits), and the extensions that such a file may have.
MAGIC = [
    ("jpg", "FFD8FF", "jpg jpeg jpe jfif"), ("png", "89504E470D0A1A0A", "png"), ("gif", "47494638(37|39)61", "gif"), ("webp", "52494646.{8}57454250", "webp"),
    ("bmp", "424D....", "bmp"), ("tif", "(49492A00|4D4D002A)", "tif tiff dng cr2 cr3 nef arw orf rw2 pef raf raw"), ("heic", ".{8}66747970.{8}", "heic heif"),
]
# Date layouts of file names.
LAYOUTS = """
yyyyMMddHHmmss, yyyyMMddHHmm, yyyyMMdd HHmmss, yyyyMMdd HHmm, yyyyMMdd_HHmmss, yyyyMMdd_HHmm,
yyMMddHHmmss, yyMMddHHmm, yyMMdd HHmmss, yyMMdd HHmm, yyMMdd_HHmmss, yyMMdd_HHmm,
yyyy-MM-dd-HH-mm-ss, yyyy-MM-dd HH-mm-ss, yyyy-MM-dd-HH-mm, yyyy-MM-dd HH-mm,
yy-MM-dd-HH-mm-ss, yy-MM-dd HH-mm-ss, yy-MM-dd-HH-mm, yy-MM-dd HH-mm,
yyyy_MM_dd_HH_mm_ss, yyyy_MM_dd_HH_mm, yyyy_MM_dd HH_mm_ss, yyyy_MM_dd HH_mm,
yy_MM_dd_HH_mm_ss, yy_MM_dd_HH_mm, yy_MM_dd HH_mm_ss, yy_MM_dd HH_mm,
yyyyMMdd, yyyy-MM-dd, yyyy_MM_dd, yyMMdd, yy-MM-dd, yy_MM_dd, ddMMyyyy, dd-MM-yyyy, dd_MM_yyyy, ddMMyy, dd-MM-yy, dd_MM_yy
"""
# Folder words that say nothing of a photo.
STOP_WORDS = """photos, photo, pictures, pics, images, img, dcim, camera, originals, backup, backups, archive, archived, misc, new folder, raw, jpg,
jpeg, png, users, user, home, documents, desktop, appdata, local, roaming, library, caches, temp, tmp, windows, program files, system32,
my pictures, my documents, c, d, e, f, g, h"""
CENTURY_FROM = 50


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split(",")]


def default_date(created: Column, modified: Column, earliest: str = "1990-01-01") -> Column:
    """The file date that a name's missing parts come from: the created one if it is late enough, else the modified one;
    of two late enough the earlier."""
    least = F.lit(earliest).cast("timestamp_ntz")
    base = F.when(created >= least, created).otherwise(modified)
    return F.when((modified < base) & (modified >= least), modified).otherwise(base)


def filename_dates(files: DataFrame, earliest: str = "1990-01-01") -> DataFrame:
    """file_id, layout, named: the date that each layout finds in the name (its first place), one row a layout that hits.

    files has name, created and modified. Separators of a layout may be missing, or be several of - _ . / \\ and :; years of
    two digits lie in 1950 to 2049; a time of day that the layout lacks is that of default_date. Impossible dates are
    dropped. Layouts that differ in the separator only share a pattern; all patterns run over a batch of names in Python,
    about ten times as fast here as the same patterns as column expressions.
    """
    same: dict[str, list[str]] = {}
    for layout in sorted(listed(LAYOUTS), key=len, reverse=True):
        parts = re.findall(r"y+|M+|d+|H+|m+|s+|[-_]| ", layout)
        same.setdefault("".join(r"[-_./\\:]*" if p in "-_" else " " if p == " " else rf"(?P<{p[0]}>[0-9]{{{len(p)}}})" for p in parts), []).append(layout)
    default = default_date(F.col("created").cast("timestamp_ntz"), F.col("modified").cast("timestamp_ntz"), earliest)
    rows = files.select("file_id", "name", default.alias("base")).filter("name is not null and base is not null")
    schema = rows.select("file_id").schema.add("layout", "string").add("named", "timestamp_ntz")

    def dated(found: dict[str, str], base: dt.datetime) -> dt.datetime | None:
        year = int(found["y"])
        if len(found["y"]) == 2:
            year += 2000 if year < CENTURY_FROM else 1900
        clock = [int(found.get(k, other)) for k, other in (("H", base.hour), ("m", base.minute), ("s", base.second))]
        try:
            return dt.datetime(year, int(found["M"]), int(found["d"]), *clock)
        except ValueError:
            return None

    def search(batches):
        patterns = [(re.compile(p), layouts) for p, layouts in same.items()]
        for b in batches:
            out = [[], [], []]
            for file_id, name, base in zip(*(b.column(c).to_pylist() for c in ("file_id", "name", "base")), strict=True):
                for pattern, layouts in patterns:
                    if (m := pattern.search(name)) and (named := dated(m.groupdict(), base)):
                        for layout in layouts:
                            for column, value in zip(out, (file_id, layout, named), strict=True):
                                column.append(value)
            kinds = (b.schema.field("file_id").type, pa.string(), pa.timestamp("us"))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["file_id", "layout", "named"])

    return rows.mapInArrow(search, schema)


def target_path(files: DataFrame, root: str, folders: list[str]) -> DataFrame:
    """file_id and the target: root, one folder per date pattern, and the name's extension in lower case."""
    parts = [F.date_format("captured", p) for p in folders]
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return files.filter("captured is not null").select("file_id", F.concat(F.concat_ws("/", F.lit(root), *parts), ext).alias("target"))


def date_shift_plan(photos: DataFrame, seconds: int) -> DataFrame:
    """Current and shifted date, whether it changes, and whether the file's family can be written."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    shifted = F.col("captured") + F.make_dt_interval(secs=F.lit(seconds))
    return photos.filter("captured is not null").select("file_id", "captured", shifted.alias("shifted"), (F.col("captured") != shifted).alias("changed"), ext.isin("jpg", "jpeg").alias("writable"))


def on_this_day(photos: DataFrame, today: str) -> DataFrame:
    d = F.lit(today).cast("date")
    return photos.filter((F.month("captured") == F.month(d)) & (F.dayofmonth("captured") == F.dayofmonth(d)) & (F.year("captured") != F.year(d)))


# Headings by window.
HEADINGS = {"Day": "On this day", "Week": "This week", "Month": "This month", "Year": "This year", "Decade": "This decade"}


def memory_header(groups: DataFrame, today: str) -> DataFrame:
    """memories() rows of `today` with match_date and a heading: the window, how long ago, and the date in the year of the
    group (of a week the same day, of a month its first); a year names itself, a decade its first year."""
    day = F.lit(today).cast("date")
    first = F.make_date("key", F.when(F.col("time_window").isin("Day", "Week", "Month"), F.month(day)).otherwise(1), F.lit(1))
    match = F.when(F.col("time_window").isin("Day", "Week"), F.date_add(first, F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(first))) - 1)).otherwise(first)
    ago = F.when(F.col("years_ago") == 1, "1 year ago").otherwise(F.concat(F.col("years_ago").cast("string"), F.lit(" years ago")))
    name = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])[F.col("time_window")]
    head = (
        F.when(F.col("time_window") == "Year", F.concat(name, F.lit(" ("), F.col("key").cast("string"), F.lit(")")))
        .when(F.col("time_window") == "Decade", F.concat(name, F.lit(", "), ago, F.lit(" ("), F.col("key").cast("string"), F.lit("s)")))
        .otherwise(F.concat(name, F.lit(", "), ago, F.lit(" ("), F.date_format("match_date", "MMMM d, yyyy"), F.lit(")")))
    )
    return groups.withColumn("match_date", match).withColumn("header", head)


WINDOWS = ["Day", "Week", "Month", "Year", "Decade"]


def memories_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.array_position(F.array(*map(F.lit, WINDOWS)), F.col("time_window")), F.abs("years_ago"), "years_ago", "file_id")


def path_keywords(photos: DataFrame, levels: int = 4) -> DataFrame:
    """file_id and the words of up to `levels` parent folders: lower case, no stop words, numbers or dates, distinct."""
    folders = F.slice(F.reverse(F.filter(F.split("dir", "/"), lambda x: x != "")), 1, levels)
    words = F.transform(F.flatten(F.transform(folders, lambda f: F.split(f, r"[ _\-.+]+"))), lambda w: F.lower(F.regexp_replace(F.trim(w), r"^[()\[\]{},;!?]+|[()\[\]{},;!?]+$", "")))
    date = r"^\d{4}([-_.]?\d{1,2}([-_.]?\d{1,2})?)?$"
    good = F.filter(words, lambda w: F.length(w).between(2, 40) & ~w.rlike(r"^[0-9]+$") & ~w.rlike(date) & ~w.rlike("^[a-z]:$") & ~w.isin(listed(STOP_WORDS)))
    return photos.select("file_id", F.array_distinct(good).alias("words"))


def detector_fallback(primary: Column, other: Column) -> Column:
    return F.when(F.size(F.coalesce(primary, F.array().cast("array<string>"))) > 0, primary).otherwise(other)


def keyword_paths(nodes: DataFrame) -> DataFrame:
    """node_id, name, path: the names from the root to each node (node_id, parent_id, name), however deep.

    A node knows the names up to some ancestor; in a round it takes on what that ancestor knows, so the known part doubles
    and the rounds are the logarithm of the depth. Nodes whose chain leaves the table are not in the tree; a circle is an
    error.
    """
    state = written(nodes.select("node_id", "name", F.col("parent_id").alias("up"), F.array("name").alias("path")))
    reach, total = 1, state.count()
    while state.filter("up is not null").limit(1).count():
        if reach > total:
            raise ValueError("keywords are nested in a circle")
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = state.filter("up is not null").join(above, "up").select("node_id", "name", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        state, reach = written(state.filter("up is null").unionByName(joined)), reach * 2
    return state.select("node_id", "name", "path")


def keyword_expand(photos: DataFrame, paths: DataFrame) -> DataFrame:
    """file_id, keyword: every keyword with all names above each node of its name; unknown words stay, trimmed.

    Photos share few lists of words, so a list is expanded once, and its names are dealt to the photos that have it; the rows
    of the result are made last and do not move.
    """
    words = F.filter(F.transform("keywords", lambda w: F.trim(w)), lambda w: w != "")
    files = photos.select("file_id", words.alias("_words")).filter(F.size("_words") > 0).groupBy("file_id").agg(F.flatten(F.collect_list("_words")).alias("_words"))
    files = written(files.select("file_id", F.sort_array(F.array_distinct("_words")).alias("_words")))
    # Each name's own chain of names, once; nodes of one name and shared ancestors fall together before the join.
    tree = paths.select(F.lower("name").alias("_key"), F.explode("path").alias("above")).groupBy("_key", F.lower("above").alias("_a")).agg(F.min("above").alias("above"))
    lists = files.select("_words").distinct().select("_words", F.explode("_words").alias("word")).withColumn("_key", F.lower("word"))
    found = lists.join(tree.drop("_a"), "_key", "left").withColumn("keyword", F.coalesce("above", "word"))
    names = found.groupBy("_words", F.lower("keyword").alias("_k")).agg(F.min("keyword").alias("keyword"))
    names = written(names.groupBy("_words").agg(F.collect_list("keyword").alias("_names")))
    return files.join(names, "_words").select("file_id", F.explode("_names").alias("keyword"))


def vocabulary_clean(lines: DataFrame) -> DataFrame:
    """Words of (line_no, line): trimmed, lower case, no blanks or '#' lines, distinct in order of first line."""
    w = lines.select("line_no", F.lower(F.trim("line")).alias("word")).filter("word <> '' and not startswith(word, '#')")
    return w.groupBy("word").agg(F.min("line_no").alias("line_no"))


def vocabulary_hash(words: DataFrame) -> DataFrame:
    """First 8 bytes of the SHA-256 over the words in order, each with a line end; a vocabulary is one small text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word"))), lambda s: F.concat(s["word"], F.lit("\n"))), "")
    return words.agg(F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def calendar_grid(photos: DataFrame, month: str) -> DataFrame:
    """42 days from the Monday on or before the first of the month: day, in_month, n, first_name and the names of its photos
    in order, without regard to case; undated photos count by mtime. Only photos of those days are grouped; a cell's list is
    its result, so it is as long as the day's photos."""
    begin = F.trunc(F.lit(month).cast("date"), "month")
    first = F.date_trunc("week", begin).cast("date")
    day = F.to_date(F.coalesce("captured", "mtime"))
    shown = photos.withColumn("day", day).filter(F.col("day").between(first, F.date_add(first, 41)))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("key"), "name"))), lambda x: x["name"])
    days = shown.groupBy("day").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), names.alias("names"))
    grid = photos.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_add(first, 41))).alias("day"))
    none = F.array().cast("array<string>")
    return grid.join(days, "day", "left").select("day", (F.trunc("day", "month") == begin).alias("in_month"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first_name", F.coalesce("names", none).alias("names"))


def calendar_totals(photos: DataFrame) -> DataFrame:
    """One row: photos, the days that have any, and the first of the latest photo's month (null without photos)."""
    days = photos.groupBy(F.to_date(F.coalesce("captured", "mtime")).alias("day")).agg(F.count("*").alias("n")).filter("day is not null")
    return days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("photos"), F.count("*").alias("days"), F.trunc(F.max("day"), "month").alias("month"))


def supported_formats(files: DataFrame) -> DataFrame:
    """Files per format family, by extension without regard to case; others do not count."""
    family = F.create_map(*[F.lit(x) for f, exts in FORMATS.items() for e in exts for x in (e, f)])
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return files.select(family[ext].alias("family")).filter("family is not null").groupBy("family").agg(F.count("*").alias("n"))


def file_signature(files: DataFrame) -> DataFrame:
    """file_id, the format that the content's first 16 bytes show (`real`, null if none), whether the name's extension is
    one of that format's (`matches`), and the extension it should have where it is not (`suggested`)."""
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, 16))
    long_enough = F.length(head) >= 8
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    real = F.coalesce(*[F.when(long_enough & F.rlike(head, F.lit("^" + magic)), F.lit(name)) for name, magic, _ in MAGIC])
    fits = F.coalesce(*[F.when(F.col("real") == name, ext.isin(exts.split())) for name, _, exts in MAGIC])
    rows = files.select("file_id", "name", real.alias("real")).withColumn("matches", fits)
    return rows.select("file_id", "real", "matches", F.when(~F.col("matches"), F.col("real")).alias("suggested"))


def incremental_scan(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files that are new, or whose time differs from the snapshot's; paths without regard to case."""
    seen = snapshot.select(F.lower("path").alias("_p"), F.col("mtime").alias("_m"))
    return listing.join(seen, (F.lower("path") == F.col("_p")) & (F.col("mtime") == F.col("_m")), "left_anti")


def source_roots_prune(roots: DataFrame) -> DataFrame:
    """Roots (root, recursive) that no other recursive root covers. Every ancestor is looked up, so no pair is compared."""
    r = roots.groupBy(F.regexp_replace("root", "/+$", "").alias("root")).agg(F.max("recursive").alias("recursive"))
    parts = F.split("root", "/")
    up = r.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_above"))
    covered = up.filter("_above <> root").join(r.filter("recursive").select(F.col("root").alias("_above")), "_above").select("root").distinct()
    return r.join(covered, "root", "left_anti")


def source_root_of_file(photos: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id and the longest root at or above its folder; files outside all roots have none."""
    parts = F.split("dir", "/")
    up = photos.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    return up.join(roots.select("root").distinct(), "root").groupBy("file_id").agg(F.max_by("root", F.length("root")).alias("root"))


def first_seen_last_seen(points: DataFrame, by: str) -> DataFrame:
    """Start, end and number of points of each track."""
    return points.groupBy(by).agg(F.min("captured").alias("start_ts"), F.max("captured").alias("end_ts"), F.count("*").alias("n"))


def histogram_percentile(bins: DataFrame, by: str, share: float) -> DataFrame:
    """The first bin at which the counts reach max(1, floor(total * share)), from rows (by, bin, n)."""
    w = Window.partitionBy(by)
    run = bins.withColumns({"_sum": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
    return run.filter(F.col("_sum") >= F.greatest(F.lit(1), F.floor(F.col("_all") * share))).groupBy(by).agg(F.min("bin").alias("bin"))
