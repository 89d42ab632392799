"""Helpers that the training-data operators share."""

from __future__ import annotations

import zlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

#: The word pattern of every contract: anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Frees a query's shuffle files when it ends; Spark's public setting, off by default.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    with freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for names used on the way."""
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def with_outputs(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """df plus the fields `names` of the struct `made`; they replace columns of the same name (compared without case)."""
    at = free_prefix(df) + "made"
    taken = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.withColumn(at, made).select(*kept, *[F.col(at)[n].alias(n) for n in names])


def set_aside(df: DataFrame, inside: list[str], outputs: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with those columns renamed whose names an operator uses `inside`; and the columns that give back all of df's but
    the ones that `outputs` replace (names compared without case)."""
    p, away = free_prefix(df), {n.lower() for n in [*inside, *outputs]}
    names = {c: f"{p}{i}" if c.lower() in away else c for i, c in enumerate(df.columns)}
    gone = {n.lower() for n in outputs}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items() if c.lower() not in gone]


def word_count(text) -> Column:
    """The number of the contract's words; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP)))


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def crc_mod(col, m: int) -> F.Column:
    return F.crc32(F.encode(F.col(col).cast("string"), "utf-8")) % m


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, chosen by hash order of the key: a top-k, so every task keeps at most `rows` rows."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def excerpt(text, chars: int, pieces: int = 8) -> F.Column:
    """The whole text up to `chars` characters, else `pieces` equal pieces spread evenly from its start to its end."""
    text, size = F.col(text), chars // pieces
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.floor(i * (F.length(text) - size) / (pieces - 1)).cast("int") + 1)
    spread = F.concat_ws("\n", F.transform(at, lambda a: F.substring(text, a, F.lit(size))))
    return F.when(F.length(text) <= chars, text).otherwise(spread)


def quotas(counts: list[int], rows: int) -> list[int]:
    """Rows to draw per stratum: half of `rows` in equal shares, half in proportion, what small strata lack goes to others."""
    got, left = [0] * len(counts), min(rows, sum(counts))
    while left:
        room = [i for i, c in enumerate(counts) if got[i] < c]
        rest = sum(counts[i] - got[i] for i in room)
        give = [min(counts[i] - got[i], int(left / 2 / len(room) + left / 2 * (counts[i] - got[i]) / rest)) for i in room]
        if not sum(give):
            give = [int(k < left) for k in range(len(room))]
        for i, g in zip(room, give, strict=True):
            got[i] += g
        left -= sum(give)
    return got


def stratified_sample(df: DataFrame, key: str, rows: int, label: str | None = None) -> DataFrame:
    """At most `rows` rows, drawn by hash of the key within each label, in quotas() of the label's count.

    Rows are counted first, so about 1.5 times the sample passes a hash threshold and is sent at all. Of more labels than
    `rows`, the most frequent take part.
    """
    by = F.col(label).cast("string") if label else F.lit("")
    counts = df.groupBy(by.alias("_l")).count().filter("_l is not null").orderBy(F.desc("count"), "_l").limit(rows).collect()
    take = quotas([r["count"] for r in counts], rows)
    plan = [(r["_l"], q, (1.5 * q + 20) / r["count"]) for r, q in zip(counts, take, strict=True)]
    plan = df.sparkSession.createDataFrame(plan, "_l string, _q int, _share double")
    h = F.xxhash64(key)
    near = df.withColumn("_l", by).join(F.broadcast(plan), "_l").filter(F.pmod(h, F.lit(1 << 30)) / (1 << 30) < F.col("_share"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy(F.pmod(h, F.lit(1 << 30)), h, key)))
    return near.filter(F.col("_n") <= F.col("_q")).select(*df.columns)
