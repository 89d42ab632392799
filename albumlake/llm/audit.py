"""Filter interaction audit: what every order of a set of filters removes, and what each step owes to the steps before.

Every document fails some filters; the bits of those make its mask. Only mask cells are counted (per part at most
2^filters masks x 4 label states, whatever the input). A recursive CTE then extends filter prefixes by the letters they
lack: a level joins the prefixes with the cells of their part, carries the bits applied and emits that step's counts.

A null text is an empty one, a null part the empty string. A document is a copy if a smaller doc_id has an identical text
anywhere in the table; rows of one doc_id are not copies of each other, and a row without doc_id never is one. Repeated rows
count each. Several labels of one doc_id: good or toxic if any says so. No documents give no rows; input columns other
than doc_id, text, the part's and the labels' are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, materialise, table

BLANKS = " \t\n\x0b\x0c\r"
#: Spark ends a recursion at this many rows; here their number is the output's, 326 a part for five filters.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters on a text alone: too few words, too few distinct words, too many capitals, markup characters."""
    trimmed = F.trim(text, F.lit(BLANKS))
    words = F.split(trimmed, GAP)
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, part: str = "source", text: str = "text") -> DataFrame:
    """part, mask, good, toxic, n: the documents of a part that fail just the filters of the mask's bits.

    `failures` are expressions over the column named _text, A to D by default; the copy filter takes the next bit. Rows
    shrink to a digest of the text before they move: by doc_id to the labels, then, counted per digest and cell, by
    digest. Copies collapse before the second move, so a digest has as many rows as parts and label states, at most.
    """
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    failures = failures or text_failures(F.col("_text"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures.values())), F.lit(0))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.alias("mask"))
    marks = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    cell = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", *cell).agg(F.count("*").alias("n"))  # in place after the join; only repeated rows shrink
    cells = rows.groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    single = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), single.alias("n")), F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("n") - single).alias("n")))
    split = cells.withColumn("least", least).select("part", "good", "toxic", F.explode(split).alias("x"))
    return split.filter("x.n > 0").groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


@contextmanager
def unlimited(spark: SparkSession):
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def audit_orders(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and COUNTS of every order of `letters` (bit i of a mask is the i-th letter)."""
    spark = cells.sparkSession
    parts = materialise(cells.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells")))

    def total(which: str) -> str:
        return f"aggregate(c.cells, 0L, (a, x) -> a + if({which}, x.n, 0L))"

    fails, before = "(x.mask & f.bit) <> 0", "(x.mask & s.applied) <> 0"
    filters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    steps = spark.sql(
        f"""
        with recursive filters(letter, bit) as (values {filters}),
        steps(part, prefix, letter, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) as (
          select part, '', '', 0, 0, total, 0L, 0L, 0L, 0L, 0L from {{parts}}
          union all
          select s.part, concat(s.prefix, f.letter), f.letter, s.step + 1, s.applied | f.bit,
            {total("(x.mask & (s.applied | f.bit)) = 0")}, {total(f"{fails} and not {before}")}, {total(f"{fails} and {before}")},
            {total("x.mask = f.bit")}, {total(f"{fails} and not {before} and x.good")}, {total(f"{fails} and not {before} and x.toxic")}
          from steps s join {{parts}} c on c.part = s.part join filters f on (s.applied & f.bit) = 0
        )
        select * from steps where step > 0""",
        parts=parts,
    )
    with unlimited(spark):
        steps = materialise(steps)
    n = len(letters)
    # A prefix of k letters begins (n - k)! orders.
    share = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(n - F.col("step"))).alias("shapley"))
    orders = steps.filter(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("at"))
    orders = orders.withColumn("prefix", F.left(F.col("filter_order"), F.col("at"))).drop("at")
    return orders.join(steps, ["part", "prefix"]).join(share, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audit_orders(mask_cells(docs, labels), "ABCDE")


#: The same rows without masks of cells or a recursion: each of the 120 orders is judged on all masks at once.
SQL = r"""
with d as (select doc_id, coalesce(text, '') t, coalesce(source, '') part from documents),
firsts as (select t, min(doc_id) lo from d group by 1),
w as (select doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from d),
m as (select doc_id, part, cast(len(w) < 50 as int) a, cast(100 * len(list_distinct(w)) < 65 * len(w) as int) b,
    cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as int) c, cast(regexp_matches(t, '[#$%&*|]') as int) d,
    cast(coalesce(w.doc_id > f.lo, false) as int) e from w join firsts f using (t)),
k as (select part, [a, b, c, d, e] f, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic
    from m left join (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by 1) l using (doc_id) group by 1, 2),
i as (select unnest([1, 2, 3, 4, 5]) i),
o as (select [p.i, q.i, r.i, s.i, u.i] o from i p, i q, i r, i s, i u where len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
x as (select part, array_to_string(list_transform(o, lambda y: chr(64 + y)), '') filter_order, step.i step, o[step.i] letter, n, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    f[o[step.i]] = 1 fails, len(list_filter(o[:step.i - 1], lambda y: f[y] = 1)) > 0 gone, list_sum(f) fs from k, o, i step),
g as (select part, filter_order, step, letter, sum(case when not fails and not gone then n else 0 end) kept, sum(case when fails and not gone then n else 0 end) removed,
    sum(case when fails and gone then n else 0 end) redundant, sum(case when fails and fs = 1 then n else 0 end) unique_fails,
    sum(case when fails and not gone then good else 0 end) good_lost, sum(case when fails and not gone then toxic else 0 end) toxic_lost from x group by 1, 2, 3, 4)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) shapley from g"""
