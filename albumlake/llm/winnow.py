"""Benchmark decontamination by winnowing: fingerprints find every shared span of `window` words, windows confirm it.

A text's k-grams of words are hashed; of every `window` consecutive words the least hash is a fingerprint. Two texts that
share `window` words share that least hash, whatever surrounds it, so a document with none of the items' fingerprints
shares no such span. Where a fingerprint hits, the hit is extended: the document's windows over it are looked up among the
items' distinct windows, word for word. Items of fewer words are one window each, with a fingerprint of their whole length.

All on native functions, in one pass over the documents. Items' tables are broadcast in blocks of a counted size: a larger
benchmark takes more passes, never a larger broadcast. Windows carry the class of the items they occur in, so documents
with a frequent window are not multiplied by its items.

A null text or item text has no words; a document without words has no spans; an empty benchmark hits nothing. Each input
row is judged on its own and gives one row (repeated rows too). Items repeated under one id count once; a null item_id is
written as an empty one. Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

WINDOW, GRAM = 10, 4
#: What is not a word, once A-Z are lower-cased: ASCII but for digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct windows and their characters in one broadcast (about 10 MB and 30 MB).
BLOCK_ROWS, BLOCK_CHARS = 100_000, 8_000_000


def words(text: Column) -> Column:
    """lower() equals folding A-Z where there is nothing but ASCII, and is much faster."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BREAK), "")


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, n: Column, k: int) -> Column:
    """The hash of every k words."""
    return F.transform(_upto(n - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def paired(name: str, step: int, join: Callable[[Column, Column], Column]) -> Column:
    return F.transform(name, lambda x, i: join(x, F.get(F.col(name), i + step)))


def over(d: DataFrame, source: str, made: str, size: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """d plus the array `made`: at i, join() over source[i .. i + size), from halves that may overlap.

    Each step is a column of its own, so a step reads two elements whatever the size. Past the last whole run of `size`
    elements the values mean nothing.
    """
    at, held = source, 1
    while held < size:
        step = min(held, size - held)
        d = d.withColumn(f"{made}{held + step}", paired(at, step, join))
        at, held = f"{made}{held + step}", held + step
    return d.withColumn(made, F.col(at))


ENTRY = "array<struct<start:int,end:int,size:int,print:bigint>>"


def whole(g: Column, size: int) -> Column:
    return F.transform(g, lambda x, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.lit(size).alias("size"), x.alias("print")))


def printed(rows: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """rows (_w: words) plus _n and _prints: runs of windows [start, end) of `size` words with one fingerprint."""
    d = rows.withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    d = over(d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))) if k == 1 else d, "_h" if k == 1 else "_w", "_g", k, F.xxhash64)
    d = over(d, "_g", "_m", window - k + 1, F.least)
    m, at = F.col("_m"), F.col("_at")
    d = d.withColumn("_at", F.filter(_upto(n - (window - 1)), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1))))
    runs = F.transform(at, lambda s, j: F.struct(s.alias("start"), F.coalesce(F.get(at, j + 1), n - (window - 1)).alias("end"), F.lit(window).alias("size"), F.get(m, s).alias("print")))
    parts = [runs.cast(ENTRY)]
    for size in short:
        parts.append(whole(grams(w, n, size), size).cast(ENTRY))
    return d.withColumn("_prints", F.concat(*parts)).select(*rows.columns, "_n", "_prints")


def spelled(start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col("_w"), start + 1, size), " ")


def item_windows(items: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows (seen, print, class), the items of each class (class, item), and the lengths of short items."""
    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    short = sorted(r[0] for r in d.select(F.size("_w")).filter(F.size("_w") < window).distinct().collect())  # window - 1 numbers at most
    d = printed(d, window, k, short).withColumn("_p", F.explode_outer("_prints")).filter((F.col("_p.size") == window) | (F.col("_p.size") == F.col("_n")))
    d = d.withColumn("_s", F.explode(F.sequence(F.col("_p.start"), F.col("_p.end") - 1)))
    d = materialise(d.select("item", F.col("_p.print").alias("print"), spelled(F.col("_s"), F.col("_p.size")).alias("seen")).distinct())
    # Windows of the same items have the same count and sums of two hashes; a class is listed from one of its windows.
    sums = [F.sum(F.xxhash64(F.lit(i), "item").cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    of = d.groupBy("seen", "print").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("class"))
    of = materialise(of)
    one = of.groupBy("class").agg(F.min("seen").alias("seen"))
    classes = materialise(d.join(one, "seen").select("class", "item"))
    release(d)
    return of, classes, short


def shared_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) in words, merged) and items (sorted) of every document."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    seen, classes, short = item_windows(items, window, k)
    size = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seen")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-size["chars"] // BLOCK_CHARS))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("_w"))
    rows = printed(rows, window, k, short)
    # A document's own row goes along with its fingerprints: nothing is scanned twice, documents without a hit remain.
    own = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("print"))).cast(ENTRY)

    def hits(block: int) -> DataFrame:
        part = seen.filter(F.pmod("print", F.lit(blocks)) == block)
        # The outer form: else Spark filters on the array's size below all projections and works it out twice.
        d = rows.select("doc_id", "_row", "_n", "_w", F.explode_outer(F.concat(own, "_prints") if block == 0 else F.col("_prints")).alias("_p"))
        d = d.select("doc_id", "_row", "_n", "_w", "_p.*")
        d = d.join(F.broadcast(part.select("print", F.lit(True).alias("_hit")).distinct()), "print", "left").filter("_hit or start < 0")
        d = d.withColumn("start", F.explode(F.sequence(F.col("start"), F.greatest(F.col("end") - 1, F.col("start")))))
        d = d.select("doc_id", "_row", "_n", "start", "size", F.when(F.col("start") >= 0, spelled(F.col("start"), F.col("size"))).alias("seen"))
        return d.join(F.broadcast(part.select("seen", "class")), "seen", "left").filter("class is not null or start < 0")

    found = reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)]) if blocks > 1 else hits(0)
    per = found.groupBy("_row", "doc_id", F.col("_n").cast("long").alias("n_words")).agg(
        F.array_sort(F.collect_list(F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("_at"),
        F.array_sort(F.collect_set("class")).alias("_classes"),
    )
    per = materialise(per.select("doc_id", "n_words", merged(F.col("_at")).alias("spans"), "_classes"))
    hit = per.filter(F.size("_classes") > 0)
    lists = hit.select("_classes").distinct().withColumn("class", F.explode("_classes")).join(classes, "class")
    lists = lists.groupBy("_classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = per.filter(F.size("_classes") == 0).select("doc_id", "n_words", "spans", F.array().cast("array<string>").alias("items"))
    return none.unionByName(hit.join(lists, "_classes").select("doc_id", "n_words", "spans", "items"))


def merged(at: Column) -> Column:
    """Sorted intervals as the maximal spans that they cover."""
    kind = "array<struct<start:int,end:int>>"
    # A run begins where an interval starts past the end of the one before; ends ascend but for intervals of two sizes.
    ends = F.transform(at, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    fold = F.aggregate(
        ends,
        F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("open")),
        lambda a, x: F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), x.alias("open")))
        .when(x["start"] <= a["open"]["end"], F.struct(a["done"].alias("done"), F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], x["end"]).alias("end")).alias("open")))
        .otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), x.alias("open"))),
    )
    out = F.transform(F.array(fold), lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return F.when(F.size(at) == 0, F.array().cast(kind)).otherwise(F.get(out, F.lit(0)))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return shared_spans(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: All windows of ten words compared as lists; no fingerprints.
SQL = r"""
with b as (select coalesce(cast(item_id as varchar), '') item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
bl as (select item, w, least(len(w), 10) size from b where len(w) > 0),
bw as (select distinct item, size, array_to_string(w[s:s + size - 1], ' ') seen from (select item, w, size, unnest(range(1, len(w) - size + 2)) s from bl)),
d as (select row_number() over () r, doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) w from documents),
dw as (select r, size, s, array_to_string(w[s:s + size - 1], ' ') seen from (select r, w, size, unnest(range(1, len(w) - size + 2)) s from d, (select distinct size from bl))),
h as (select dw.r, dw.s, dw.size, bw.item from dw join bw using (size, seen)),
p as (select r, count(distinct x) n from (select r, unnest(range(s, s + size)) x from (select distinct r, s, size from h)) group by 1),
i as (select r, count(*) n, array_to_string(list(item order by item), ',') items from (select distinct r, item from h) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(p.n, 0) n_hit, coalesce(i.n, 0) n_items, sha256(coalesce(items, '')) items_sha256, p.n is not null contaminated
from d left join p using (r) left join i using (r)"""
