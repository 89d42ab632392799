"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot in fixed-stride shards.

Documents are cut in sequences of `length` ids, the last padded with the end id; each ends with an end id. Ids take two
bytes where the vocabulary has at most 65,536 pieces, else four; the end id is the vocabulary's own. Null and
empty texts are one sequence of end ids. A sequence's index is its place in the table of sequences, which is written once,
so repeated rows and repeated ids are separate sequences; over the same files in the same splits the order is the same.
Other columns are not read. An empty table gives no slots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed_shuffles, materialise, release, shared_dir, table
from .wfst import ROWS, _slices, _transducer, default_vocabulary, read_vocabulary

LENGTH, PER_SHARD, SHARDS_PER_TASK, SEED, ROUNDS = 512, 16_384, 2, 2026, 6


def id_format(model: bytes) -> tuple[str, int]:
    """The type of stored ids and the end id of a vocabulary; one without an end piece can't be used."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if sp.eos_id() < 0:
        raise ValueError("the vocabulary has no end piece")
    return ("<u2" if sp.get_piece_size() <= 1 << 16 else "<u4"), sp.eos_id()


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, total: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Bijection of range(total): a balanced Feistel network on the next even power of two, walked until inside."""
    half = max((max(total - 1, 1).bit_length() + 1) // 2, 1)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, seed * 1_000_003 + r) & mask)
        out[todo] = (left << shift) | right
        todo = out >= np.uint64(total)
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """doc_id, seq_no, ids binary (little-endian, fixed stride of id_format's width * length bytes)."""
    model = read_vocabulary(vocabulary or default_vocabulary())
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind, end_id = id_format(model)
    stride = int(kind[-1]) * length

    def run(batches):
        t = _transducer(held.value)
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            docs_, at = b.column("doc_id").to_numpy(zero_copy_only=False), 0
            for ids, counts, _ in t.encode_texts(b.column("text").to_pylist()):
                n = counts // length + 1  # the ids and one end id at least
                flat = np.full(int(n.sum()) * length, end_id, kind)
                flat[_slices((np.cumsum(n) - n) * length, counts)] = ids
                total = int(n.sum())
                data = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(0, (total + 1) * stride, stride, dtype=np.int32)), pa.py_buffer(flat)])
                yield pa.record_batch([pa.array(np.repeat(docs_[at : at + len(n)], n), pa.int64()), pa.array(_slices(np.zeros(len(n), np.int64), n), pa.int32()), data], names=["doc_id", "seq_no", "ids"])
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, seq_no int, ids binary")


def slotted(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = SEED, vocabulary: str | None = None) -> tuple[DataFrame, int, DataFrame]:
    """One row per sequence, in no order: slot, shard, offset (bytes in the shard), doc_id, seq_no, ids; their number; and
    the written table that they are read from.

    The sequences are written once, each with its task and its place in it. A table of one row per task gives where its
    index starts, so every row has its index, and by the permutation its slot, without a shuffle.
    """
    id_ = F.monotonically_increasing_id()
    width = int(id_format(read_vocabulary(vocabulary or default_vocabulary()))[0][-1])
    made = sequences(docs, length, vocabulary).select("*", F.shiftright(id_, 33).cast("int").alias("task"), id_.bitwiseAND((1 << 33) - 1).alias("place"))
    made = materialise(made, codec="zstd")
    tasks = made.groupBy("task").count().orderBy("task").collect()
    total = sum(r["count"] for r in tasks)
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in tasks])]).tolist()
    start = made.sparkSession.createDataFrame([(r["task"], s) for r, s in zip(tasks, starts[:-1], strict=True)], "task int, start long")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, seed))

    out = made.join(F.broadcast(start), "task").select(slot(F.col("start") + F.col("place")).alias("slot"), "doc_id", "seq_no", "ids")
    return out.select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard * (width * length)).alias("offset"), "doc_id", "seq_no", "ids"), total, made


def by_shard(rows: DataFrame, total: int, per_shard: int) -> DataFrame:
    """Rows in order of slot, in range partitions of SHARDS_PER_TASK whole shards each."""
    n = max(-(-total // (per_shard * SHARDS_PER_TASK)), 1)
    return rows.repartitionById(n, F.floor(F.col("shard") / SHARDS_PER_TASK).cast("int")).sortWithinPartitions("shard", "slot")


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = SEED, vocabulary: str | None = None) -> DataFrame:
    """slotted() rows, sorted in partitions of whole shards."""
    rows, total, _ = slotted(docs, length, per_shard, seed, vocabulary)
    return by_shard(rows, total, per_shard)


SHARDS = "shard long, n int, stride int, data binary, doc_ids array<long>, seq_nos array<int>"


def write_shards(rows: DataFrame, total: int, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None) -> None:
    """One file per shard, path/shard=N/, whose `data` is the shard's ids at their offsets, one stride apart.

    Every shard is written by one task, and Spark writes the files, so the folder may be anywhere Spark can write.
    """
    stride = int(id_format(read_vocabulary(vocabulary or default_vocabulary()))[0][-1]) * length

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "n": len(part), "stride": stride, "data": b"".join(part["ids"]), "doc_ids": [part["doc_id"].to_numpy()], "seq_nos": [part["seq_no"].to_numpy()]})

    def run(batches):
        held: list[pd.DataFrame] = []  # the open shard's rows: one shard at most
        for b in batches:
            for shard, part in b.groupby("shard", sort=True):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield pack(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield pack(pd.concat(held, ignore_index=True))

    parts = by_shard(rows, total, per_shard).select("shard", "doc_id", "seq_no", "ids").mapInPandas(run, SHARDS)
    with freed_shuffles(rows.sparkSession):
        parts.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, start: int = 0, per_shard: int = PER_SHARD, rows: int = 2048) -> DataFrame:
    """Rows from slot `start` on: earlier shards' files are not opened, and ids are cut from the data by offset."""
    files = spark.read.schema(SHARDS).parquet(path).filter(F.col("shard") >= start // per_shard)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                shard, n, stride = (b.column(c)[r].as_py() for c in ("shard", "n", "stride"))
                data, docs, seqs = b.column("data")[r].as_buffer(), b.column("doc_ids")[r].values, b.column("seq_nos")[r].values
                for lo in range(max(start - shard * per_shard, 0), n, rows):
                    m = min(rows, n - lo)
                    ends = pa.py_buffer(np.arange(0, (m + 1) * stride, stride, dtype=np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), m, [None, ends, data.slice(lo * stride, m * stride)])
                    place = np.arange(lo, lo + m)
                    yield pa.record_batch(
                        [pa.array(shard * per_shard + place), pa.array(np.full(m, shard)), pa.array(place * stride), docs.slice(lo, m), seqs.slice(lo, m), ids],
                        names=["slot", "shard", "offset", "doc_id", "seq_no", "ids"],
                    )

    return files.mapInArrow(run, "slot long, shard long, offset long, doc_id long, seq_no int, ids binary")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    rows, total, made = slotted(table(spark, sf_dir, "documents"))
    write_shards(rows, total, path)
    release(made)
    return read_shards(spark, path)
