"""Operators that depend on an order: bursts, copies, histories, rename and import plans, collections, edits."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .vectors import numbered, ranked

RELIABILITY = {"Gps": 50, "SubIfd": 40, "Ifd0": 30, "FileName": 20, "Modified": 10, "Created": 1}


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def stem_distance(a: Column, b: Column) -> Column:
    """The longer length less the common beginning, without regard to case."""
    x, y = F.lower(a), F.lower(b)
    n = F.least(F.length(x), F.length(y))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(acc))
    return F.greatest(F.length(x), F.length(y)) - same


def burst_groups(photos: DataFrame, by: list[str], gap_seconds: float = 2.0, max_distance: int = 3) -> DataFrame:
    """file_id, *by, burst_first: the file a burst starts with. A new burst starts at a gap over gap_seconds, or where the
    stem is too far from that of the burst's first file.

    Gaps cut each key's day into sessions (a day's edge is compared through a table of days); the stem rule is a fold that
    streams over the sorted files of a session, of any length, and holds the burst's first stem only.
    """
    at = F.coalesce("captured", "mtime")
    key = [*by, "_day"]
    rows = photos.select("file_id", *by, "name", at.alias("at"), F.to_date(at).alias("_day"))
    w = Window.partitionBy(*key).orderBy("at", "name", "file_id")
    us = F.unix_micros(F.col("at").cast("timestamp"))
    rows = rows.withColumn("us", us)
    lag = F.lag("us").over(w)
    rows = rows.withColumn("cut", F.when(lag.isNull() | (F.col("us") - lag > gap_seconds * 1e6), 1).otherwise(0)).withColumn("head", lag.isNull())
    days = rows.groupBy(*key).agg(F.max("us").alias("hi"), F.min("us").alias("lo"))
    d = Window.partitionBy(*by).orderBy("_day")
    joined = days.withColumn("near", F.coalesce(F.col("lo") - F.lag("hi").over(d) <= gap_seconds * 1e6, F.lit(False)))
    rows = rows.join(joined.select(*key, "near"), key).withColumn("cut", F.when(F.col("head") & F.col("near"), 0).otherwise(F.col("cut")))
    # A session is named by its first instant; one that goes on from the day before takes over that day's last session.
    rows = rows.withColumn("session", F.last(F.when(F.col("cut") == 1, F.col("us")), ignorenulls=True).over(w))
    tails = rows.groupBy(*key).agg(F.max("session").alias("tail"))
    tails = tails.withColumn("carried", F.last("tail", ignorenulls=True).over(d.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(tails.select(*key, "carried"), key).withColumn("session", F.coalesce("session", "carried"))
    order = [*by, "session", "at", "name", "file_id"]
    rows = rows.repartition(*by, "session").sortWithinPartitions(*order).select("file_id", *by, "session", "name")
    schema = rows.select("file_id", *by).schema.add("burst_first", rows.schema["file_id"].dataType)

    def fold(batches):
        now = first = head = None
        for b in batches:
            ids, names = b.column("file_id").to_pylist(), b.column("name").to_pylist()
            starts = []
            for i, (key, name) in enumerate(zip(zip(*(b.column(c).to_pylist() for c in (*by, "session")), strict=True), names, strict=True)):
                here = re.sub(r"\.[^.]*$", "", name or "").lower()
                if first is None or key != now or max(len(head), len(here)) - common(head, here) > max_distance:
                    now, first, head = key, ids[i], here
                starts.append(first)
            columns = [b.column("file_id"), *(b.column(c) for c in by), pa.array(starts, b.schema.field("file_id").type)]
            yield pa.record_batch(columns, names=["file_id", *by, "burst_first"])

    return rows.mapInArrow(fold, schema)


def common(a: str, b: str) -> int:
    """How long two texts begin alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def burst_summary(bursts: DataFrame) -> DataFrame:
    sizes = bursts.groupBy("burst_first").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("bursts"), F.count_if(F.col("n") > 1).alias("multi"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def burst_name(first: Column, last: Column) -> Column:
    """'IMG_1..3' of two stems with one beginning and number tails; else the first stem."""
    form = r"^(.*?)([0-9]*)$"
    a, b = F.regexp_extract(first, form, 1), F.regexp_extract(last, form, 1)
    x, y = F.regexp_extract(first, form, 2), F.regexp_extract(last, form, 2)
    return F.when(first == last, first).when((F.lower(a) == F.lower(b)) & (x != "") & (y != ""), F.concat(a, x, F.lit(".."), y)).otherwise(first)


def burst_tag(keywords: Column, burst: Column) -> Column:
    """keywords with the burst's own in place of any other."""
    kept = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ~F.startswith(F.lower(k), F.lit("pm:burstid=")))
    return F.array_append(kept, F.concat(F.lit("pm:burstId="), burst))


def best_capture_date(candidates: DataFrame, earliest: str = "1990-01-01", latest: str = "2100-01-01", ignored: tuple[str, ...] = ("1970-01-01", "1980-01-01")) -> DataFrame:
    """Per file the date of the most reliable source, the latest of equal ones; dates outside the limits and the ignored
    ones do not count. Of a satellite date and an original's that follows it by an hour at most, the original's is taken:
    the receiver's fix was old."""
    rank = F.create_map(*[F.lit(x) for pair in RELIABILITY.items() for x in pair])[F.col("source")]
    ok = candidates.filter((F.col("ts") >= F.lit(earliest).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(latest).cast("timestamp_ntz")))
    ok = ok.filter(~F.col("ts").cast("timestamp_ntz").isin([F.lit(d).cast("timestamp_ntz") for d in ignored])) if ignored else ok
    gps, original = (F.max(F.when(F.col("source") == s, F.col("ts").cast("timestamp_ntz"))) for s in ("Gps", "SubIfd"))
    best = ok.groupBy("file_id").agg(F.max(F.struct(F.coalesce(rank, F.lit(0)).alias("rank"), "ts", "source")).alias("best"), gps.alias("gps"), original.alias("original"))
    stale = F.coalesce((F.col("original") > F.col("gps")) & (F.col("original") <= F.col("gps") + F.expr("interval 1 hour")), F.lit(False))
    return best.select("file_id", F.when(stale, F.col("original")).otherwise(F.col("best.ts")).alias("captured"), F.when(stale, "SubIfd").otherwise(F.col("best.source")).alias("source"))


KEY = ["dir", "base", "ext"]


def collision_suffix(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """file_id and final: the nth file of one target path gets ' (n)' from n = 2 on, past numbers that are taken.

    files has file_id, dir, base, ext, name; taken has dir, base, ext, n (0 for the plain name). Sorted, the ith taken number
    u (from 0) leaves u - i - 1 free ones below it, so the kth file is pushed on by every taken number with u - i <= k. Files
    and taken numbers are merged in that order and numbered by ranges of targets; one target may fill many ranges.
    """
    order = ["name", "file_id"]
    rows = ranked(files.select("file_id", "name", *KEY), KEY, order, "_at")
    number = F.col("_at")
    if taken is not None:
        used = taken.select(*KEY, F.when(F.col("n") < 1, 1).otherwise(F.col("n")).cast("long").alias("u")).distinct()
        used = ranked(used.join(rows.select(*KEY).distinct(), KEY, "left_semi"), KEY, ["u"], "_i").select(*KEY, (F.col("u") - F.col("_i") + 1).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["file_id"].dataType).alias("file_id"))
        both = used.unionByName(rows.select(*KEY, F.col("_at").alias("_k"), F.lit(1).alias("_side"), "file_id"))
        rows = ranked(both, KEY, ["_k", "_side"], "_place").filter("_side = 1")
        number = F.col("_place")  # its own rank and the taken numbers before it
    plain = F.concat("base", F.when(number > 1, F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(""), "ext")
    return rows.select("file_id", F.concat_ws("/", "dir", plain).alias("final"))


#: .NET date letters that Spark writes alike.
DATE_FORMAT = r"[yMdHms .,_\-]*"


def rename_plan(photos: DataFrame, template: str, by: list[str] | None = None) -> DataFrame:
    """file_id, new_name, status: the template's tokens filled in; an unknown token keeps its braces.

    Tokens: name, ext, date:fmt, time:fmt, year, month, day, hour, minute, second, rating, label, the place fields, title,
    caption, creator, index:fmt and total:fmt. Dates take y, M, d, H, m, s; counts zeros for their least width. The index
    runs per `by` (all photos without), in order of time and name; status tells unchanged names and later ones of equal
    names. Columns that photos lack are empty.
    """
    def two(f) -> Column:
        return F.lpad(f("captured").cast("string"), 2, "0")

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in photos.columns else F.lit(None).cast("string")

    ext = F.regexp_extract("name", r"\.([^.]*)$", 1)
    fixed = {
        "name": stem(F.col("name")), "ext": ext, "year": F.lpad(F.year("captured").cast("string"), 4, "0"), "month": two(F.month), "day": two(F.dayofmonth),
        "hour": two(F.hour), "minute": two(F.minute), "second": two(F.second), "rating": text("rating"), "label": text("color_label"),
        **{t: text(c) for t, c in (("city", "city"), ("country", "country"), ("countrycode", "country_code"), ("state", "state"), ("location", "location"), ("title", "title"), ("caption", "caption"), ("creator", "creator"))},
    }

    def filled(token: str) -> Column:
        name, colon, form = token.partition(":")
        name = name.lower()
        if name in fixed:
            return F.coalesce(fixed[name], F.lit(""))
        if name in ("date", "time"):
            form = form if colon else "yyyy-MM-dd" if name == "date" else "HHmmss"
            if not re.fullmatch(DATE_FORMAT, form):
                raise ValueError(f"unknown date format {form}")
            return F.coalesce(F.date_format("captured", form) if form else F.lit(""), F.lit(""))
        if name in ("index", "total"):
            if form.strip("0"):
                raise ValueError(f"unknown number format {form}")
            n = F.col(name).cast("string")
            return F.lpad(n, F.greatest(F.length(n), F.lit(len(form))), F.lit("0"))
        return F.lit("{" + token + "}")

    if by:
        w = Window.partitionBy(*by)
        rows = photos.withColumn("index", F.row_number().over(w.orderBy("captured", "name", "file_id"))).withColumn("total", F.count("*").over(w))
    else:
        rows = numbered(photos, ["captured", "name", "file_id"], "index").withColumn("total", F.lit(photos.count()))
    parts, at = [], 0
    while at < len(template):
        open_ = template.find("{", at)
        close = template.find("}", open_) if open_ >= 0 else -1
        if close < 0:
            parts.append(F.lit(template[at:]))
            break
        parts += [F.lit(template[at:open_]), filled(template[open_ + 1 : close])]
        at = close + 1
    base = F.trim(F.regexp_replace(F.concat(F.lit(""), *parts), r'[\\/:*?"<>|\x00-\x1F]', "_"))
    rows = rows.withColumn("new_name", F.when(ext != "", F.concat(base, F.lit("."), ext)).otherwise(base))
    again = F.row_number().over(Window.partitionBy("dir", F.lower("new_name")).orderBy("index", "file_id")) > 1
    status = F.when(F.col("new_name") == F.col("name"), "unchanged").when(again, "duplicate").otherwise("rename")
    return rows.select("file_id", "new_name", status.alias("status"))


def import_plan(incoming: DataFrame, existing: DataFrame, handling: str, preserve: bool = True) -> DataFrame:
    """file_id, final, outcome of files (file_id, dir, base, ext, name, sha) against those on disk (dir, base, ext, n, sha).

    The plain target is held by the file on disk of n = 0, else by the first file of the batch, by name, which is imported.
    Other files of the target clash: Skip and Overwrite say so; Smart skips a file that equals the holder (removes it, where
    originals are not preserved) and renames others, whatever numbered siblings hold; Rename always renames.
    """
    if handling not in ("Rename", "Skip", "Overwrite", "Smart"):
        raise ValueError(f"unknown handling {handling}")
    first = incoming.groupBy(*KEY).agg(F.min(F.struct("name", "file_id", "sha")).alias("_first"))
    there = existing.filter("n = 0").groupBy(*KEY).agg(F.lit(True).alias("_there"), F.max("sha").alias("_sha"))
    holder = first.join(there, KEY, "left").select(*KEY, F.col("_first.file_id").alias("_id"), F.coalesce("_there", F.lit(False)).alias("_there"), F.when(F.col("_there"), F.col("_sha")).otherwise(F.col("_first.sha")).alias("_sha"))
    rows = incoming.join(holder, KEY)
    outcome = F.when(~F.col("_there") & (F.col("file_id") == F.col("_id")), "imported")
    if handling in ("Skip", "Overwrite"):
        outcome = outcome.otherwise({"Skip": "skipped", "Overwrite": "overwritten"}[handling])
    else:
        outcome = (outcome.when(F.col("sha") == F.col("_sha"), "skipped" if preserve else "removed") if handling == "Smart" else outcome).otherwise("renamed")
    rows = written(rows.select("file_id", *KEY, "name", outcome.alias("outcome")))
    named = collision_suffix(rows.filter("outcome = 'renamed'"), existing.select(*KEY, "n").unionByName(rows.filter("outcome = 'imported'").select(*KEY, F.lit(0).cast("long").alias("n"))))
    plain = F.concat_ws("/", "dir", F.concat("base", "ext"))
    kept = rows.filter("outcome <> 'renamed'").select("file_id", plain.alias("final"), "outcome")
    return kept.unionByName(rows.filter("outcome = 'renamed'").select("file_id", "outcome").join(named, "file_id").select("file_id", "final", "outcome"))


def import_preview(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What a dry run says of each file: only the plain target on disk counts, as nothing is written."""
    there = existing.filter("n = 0").groupBy(*KEY).agg(F.lit(True).alias("_there"), F.max("sha").alias("_sha"))
    rows = incoming.join(there, KEY, "left")
    says = F.when(F.col("_there").isNull(), "import").when(F.col("sha") == F.col("_sha"), "skip identical").otherwise("resolve conflict")
    return rows.select("file_id", F.concat_ws("/", "dir", F.concat("base", "ext")).alias("final"), says.alias("preview"))


def import_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count("*").alias("n"))


def history_rollback(edits: DataFrame, by: list[str], order: str, back: int) -> DataFrame:
    """The snapshot `back` steps before the newest of each key; keys with fewer have none."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return edits.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") == back + 1).drop("_at")


COPY = r"(?i)^(.*)\.copy([1-9][0-9]*)\.xmp$"


def virtual_copies(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """dir, name, copy_index of sidecars '<name>.copyN.xmp' beside a file, without regard to case."""
    s = sidecars.select("dir", F.lower(F.regexp_extract("name", COPY, 1)).alias("_base"), F.regexp_extract("name", COPY, 2).alias("n")).filter("n <> ''")
    return files.withColumn("_base", F.lower("name")).join(s, ["dir", "_base"]).select("dir", "name", F.col("n").cast("long").alias("copy_index"))


def virtual_copy_next_index(copies: DataFrame) -> DataFrame:
    """The smallest free copy number of each file."""
    got = copies.groupBy("dir", "name").agg(F.collect_set("copy_index").alias("used"))
    free = F.array_except(F.sequence(F.lit(1).cast("long"), F.size("used").cast("long") + 1), F.col("used"))
    return got.select("dir", "name", F.array_min(free).alias("next_index"))


def library_rows(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Every file (copy_index 0) followed by its copies."""
    rows = files.select("dir", "name", F.lit(0).cast("long").alias("copy_index")).unionByName(copies.select("dir", "name", "copy_index"))
    return rows.orderBy("dir", "name", "copy_index")


def quick_collection(log: DataFrame) -> DataFrame:
    """Paths in the collection after a log of add, remove, toggle and clear (seq, path, op), without regard to case.

    What lies before the last clear does not count; per path the last add or remove decides, and each toggle after it
    turns the answer.
    """
    clear = log.filter("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    rows = log.filter("op <> 'clear'").crossJoin(F.broadcast(clear)).filter("seq > cleared").withColumn("path", F.lower("path"))
    last = rows.groupBy("path").agg(F.max(F.when(F.col("op") != "toggle", F.struct("seq", "op"))).alias("last"))
    after = rows.filter("op = 'toggle'").join(last, "path").filter("last is null or seq > last.seq").groupBy("path").agg(F.count("*").alias("turns"))
    state = last.join(after, "path", "left").withColumn("on", F.coalesce(F.col("last.op") == "add", F.lit(False)).cast("int"))
    return state.filter((F.col("on") + F.coalesce("turns", F.lit(0))) % 2 == 1).select("path")


def fold_edits(edits: DataFrame) -> DataFrame:
    """The last value that the log sets per path and field; a set null differs from a field left alone."""
    return edits.filter("has_value").groupBy("path", "field").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("path", "field", F.col("v.value").alias("value"))


def apply_edits(photos: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """photos with the folded edits of each field; fields that no edit names keep their value."""
    pick = [F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_{f}") for f in fields]
    wide = fold_edits(edits).groupBy("path").agg(*pick).withColumnRenamed("path", key)
    out = photos.join(wide, key, "left")
    return out.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["value"]).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def pick_reject_edit(photos: DataFrame, action: str) -> DataFrame:
    """Pick, Reject or Clear sets both flags."""
    pick, reject = {"Pick": (True, False), "Reject": (False, True), "Clear": (False, False)}[action]
    return photos.withColumns({"is_pick": F.lit(pick), "is_reject": F.lit(reject)})


def merge_keywords(old: Column, new: Column) -> Column:
    """old, then new: blanks dropped, trimmed, the first of words equal but for case kept, in order."""
    none = F.array().cast("array<string>")
    all_ = F.filter(F.transform(F.concat(F.coalesce(old, none), F.coalesce(new, none)), lambda k: F.trim(k)), lambda k: k != "")
    return F.filter(all_, lambda k, i: F.array_position(F.transform(all_, lambda x: F.lower(x)), F.lower(k)) == i + 1)


def keyword_remove(keywords: Column, word: str) -> Column:
    return F.filter(keywords, lambda k: F.lower(k) != word.lower())


def fill_place(old: Column, new: Column, overwrite: bool = False) -> Column:
    """A resolved place counts only if it is not blank, and over a filled one only when asked."""
    given = F.trim(F.coalesce(new, F.lit(""))) != ""
    empty = F.trim(F.coalesce(old, F.lit(""))) == ""
    return F.when(given & (empty | F.lit(overwrite)), new).otherwise(old)


def shuffle(photos: DataFrame, seed: int) -> DataFrame:
    """A repeatable random order, by a hash of the id."""
    return photos.orderBy(F.xxhash64(F.lit(seed), "file_id"), "file_id")
