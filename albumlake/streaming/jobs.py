"""Streams over a growing library. Every job runs on what has arrived and stops (availableNow), with its progress kept in
a checkpoint folder, so a later run takes only what is new."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.library import geofence_match
from ..operators.ordered import fold_edits
from ..shared import shared_dir


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def append_once(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append what has arrived to a table, each file once."""
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(out).awaitTermination()


def each_batch_once(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(write).start().awaitTermination()


def stream_ingest(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    append_once(shape(arriving(spark, path)), out, checkpoint)
    return spark.read.parquet(out)


def stream_geofence(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], bookmarks: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Arriving photos joined with a fixed table of bookmarks; the join is that of the batch form, batch by batch."""
    each_batch_once(shape(arriving(spark, path)), lambda b, i: geofence_match(b, bookmarks).write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, "append")
    return spark.read.parquet(out).drop("batch")


def stream_edit_fold(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """The latest value per path and field. Each batch's fold is small; the answer is a fold of the folds."""
    def write(batch: DataFrame, i: int) -> None:
        last = batch.filter("has_value").groupBy("path", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("seq").alias("seq"))
        last.select("path", "field", "seq", F.lit(True).alias("has_value"), F.col("v.value").alias("value")).write.mode("overwrite").parquet(f"{out}/batch={i}")

    each_batch_once(shape(arriving(spark, path)), write, checkpoint, "append")
    return fold_edits(spark.read.parquet(out))


def _sessions(rows: DataFrame, gap: str) -> DataFrame:
    made = rows.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start_ts"), F.col("s.end").cast("timestamp_ntz").alias("end_ts"), "n")


def stream_bursts(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], gap: str, out: str, checkpoint: str, late: str = "1 day") -> DataFrame:
    """Sessions of photos (user_id, captured) whose gaps do not exceed `gap`: user_id, start_ts, end_ts, n; final ones only.

    A session is appended once, when no photo within `late` of the newest one seen can reach it any more, and its state is
    let go. Sessions near the end stay open until newer photos arrive: open_bursts() gives them from the photos.
    """
    rows = shape(arriving(spark, path)).select("user_id", F.col("captured").cast("timestamp").alias("at")).withWatermark("at", late)
    final = _sessions(rows, gap)
    append_once(final, out, checkpoint)
    return spark.read.schema(final.schema).parquet(out)


def open_bursts(photos: DataFrame, final: DataFrame, gap: str) -> DataFrame:
    """The sessions of the photos after each user's last final one."""
    last = final.groupBy("user_id").agg(F.max("end_ts").alias("_end"))
    rows = photos.join(last, "user_id", "left").filter("_end is null or captured > _end")
    return _sessions(rows.select("user_id", F.col("captured").cast("timestamp").alias("at")), gap)


RETRY_STATE = "attempts long, last_seq long"


def stream_edit_retry(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most: int = 10, files: int | None = None) -> DataFrame:
    """edit_retry over arriving attempts (path, field, seq, failed): failures since an edit's last success are kept as state
    per (path, field), two numbers each; `most` of them make a dead letter. Attempts of one edit arrive in order of seq,
    as a queue gives them; within a batch they are sorted. A batch writes the edits that it changed, and writes them again
    if it is run again after a failure; `files` bounds the files of a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    attempts = shape((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)).select("path", "field", "seq", "failed")

    def fold(key, frames, state):
        attempts, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        rows = rows[rows["seq"] > last]  # what was counted before does not count again
        if len(rows):
            good = rows.loc[~rows["failed"], "seq"]
            attempts = int((rows["seq"] > good.max()).sum()) if len(good) else attempts + len(rows)
            last = int(rows["seq"].max())
            state.update((attempts, last))
        yield pd.DataFrame({"path": [key[0]], "field": [key[1]], "attempts": [attempts], "seq": [last]})

    kind = attempts.schema["path"].dataType.simpleString()
    folded = attempts.groupBy("path", "field").applyInPandasWithState(fold, f"path {kind}, field string, attempts long, seq long", RETRY_STATE, "update", GroupStateTimeout.NoTimeout)
    each_batch_once(folded, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint, "update")
    last = spark.read.parquet(out).groupBy("path", "field").agg(F.max_by("attempts", "seq").alias("attempts"))
    return last.filter("attempts > 0").select("path", "field", "attempts", F.when(F.col("attempts") >= most, "dead").otherwise("pending").alias("state"))


def folders(spark: SparkSession) -> tuple[str, str]:
    """A fresh table folder and a fresh checkpoint folder."""
    at = shared_dir(spark)
    return f"{at}/table", f"{at}/checkpoint"
