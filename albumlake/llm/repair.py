"""Conversation structure repair: the cheapest edits that give a legal order of roles, by a checkpointed dynamic program.

Legal are no rows, or an optional system row and then pairs of user and assistant (by the roles' first letters). States:
nothing yet, after system, after user, after assistant. Backward costs of the four states after a row give those before
it; they are kept at every sqrt(n)-th row only. Walking forward, each block's costs are worked out again from its
checkpoint, and of the tight edits the ASCII-least one is taken: of Delete, Insert, Keep and Rerole each has one outcome in
a state, so the least letter at every place is the least string.

Rows are range-partitioned by conversation and turn and streamed in order. A conversation that lies within one partition
and is not long is solved there. Those at a partition's ends, and long ones however far they reach, are cut in blocks: a
block's min-plus matrix, the costs at the blocks' ends, the edits for each state a block may begin in, then the states.
So a task holds a block, or the summaries of a conversation's blocks, never a conversation. Its sha-256 and its audit are
single values: one task streams its rows for the hash, with bounded memory, and the audit is as long as its rows.

Null roles and texts become one space, null conv_ids are one conversation, null turns come first; rows of one turn are
ordered by role, then text. Repeated rows count each, the second is a duplicate. A role without a letter can't be kept.
An empty table gives no rows, a conversation without rows zeros. Columns but conv_id, turn, role, text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

BLANKS = " \t\n\x0b\x0c\r"
#: A block's rows, and the characters from which a conversation is streamed rather than held.
BLOCK_BITS, HELD_CHARS = 12, 4_000_000
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The one role that may be given to a row, or inserted, in a state; and where it leads.
GIVEN = ["user", "user", "assistant", "user"]
NEXT = [USER, USER, ASSISTANT, USER]
DELETE, INSERT, REROLE = 3, 2, 2
LETTERS = "sua"
FAR = 1 << 40
#: Costs after the last row: what must still be inserted.
END = (0, 4, 2, 0)
#: A row's class: 0 must be deleted, else 1 + 2 * (place in LETTERS, 3 if none) + (truncated).
CLASSES = 9
#: A row's code: 3 * (place in LETTERS) + (0 sound, 1 truncated, 2 blank).
ZEROS = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def by_row(kind: int, state: int) -> dict[str, tuple[int, int]]:
    """The edits of a row of this class in a state: letter to cost and next state."""
    if kind == 0:
        return {"D": (DELETE, state)}
    at, cut = divmod(kind - 1, 2)
    out = {"D": (DELETE, state), "R": (REROLE + cut, NEXT[state])}
    if at < 3 and LETTERS[at] in KEEP[state]:
        out["K"] = (cut, KEEP[state][LETTERS[at]])
    return out


@lru_cache(maxsize=1 << 16)
def back(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row (and before what is inserted ahead of it) from those after it, less their least; and the least."""
    own = [min(c + after[y] for c, y in by_row(kind, x).values()) for x in range(4)]
    for _ in range(2):
        own = [min(own[x], INSERT + own[NEXT[x]]) for x in range(4)]
    low = min(own)
    return tuple(c - low for c in own), low


@lru_cache(maxsize=1 << 16)
def step(kind: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least tight edits up to and with this row, and the state after it."""
    before, low = back(kind, after)
    edits = ""
    while True:
        here = before[state] + low
        options = {e: y for e, (c, y) in by_row(kind, state).items() if c + after[y] == here}
        if INSERT + before[NEXT[state]] + low == here:
            options["I"] = None
        e = min(options)
        edits += e
        if e != "I":
            return edits, options[e]
        state = NEXT[state]


def walk(kinds: bytes, end: tuple[int, ...], states: list[int]) -> tuple[list[str], list[int], int]:
    """From each of `states`: the edits of these rows and the state after them; and the cost that costs before the first
    row, less their least, lack. `end`: costs after the last row, the least of them 0."""
    n = len(kinds)
    every = max(1, isqrt(n))
    held, at, total = {}, end, 0
    for i in range(n - 1, -1, -1):
        if (i + 1) % every == 0 or i == n - 1:
            held[i] = at
        at, low = back(kinds[i], at)
        total += low
    edits, states = [[] for _ in states], list(states)
    for lo in range(0, n, every):
        hi = min(lo + every, n)
        after = [held[hi - 1]]
        for i in range(hi - 1, lo, -1):
            after.append(back(kinds[i], after[-1])[0])
        for i in range(lo, hi):
            for j, x in enumerate(states):
                e, states[j] = step(kinds[i], after[hi - 1 - i], x)
                edits[j].append(e)
    return ["".join(e) for e in edits], states, total


def start_costs(kinds: bytes) -> int:
    at, total = END, 0
    for kind in reversed(kinds):
        at, low = back(kind, at)
        total += low
    return at[NONE] + total


def tail(state: int) -> str:
    return "I" * (END[state] // INSERT)


def letter(role: str) -> int:
    return LETTERS.find(role[:1]) if role[:1] and role[:1] in LETTERS else 3


def code(role: str, text: str) -> int:
    last = text.rstrip(BLANKS)[-1:]
    return 3 * letter(role) + (2 if not last else int(last not in ".!?"))


def kind_of(code: int, again: bool) -> int:
    at, fault = divmod(code, 3)
    return 0 if again or fault == 2 else 1 + 2 * at + fault


def legal(a: int, b: int) -> bool:
    """Of two adjacent places in LETTERS: su, ua or au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


class Replay:
    """Applies edits to rows in order and hashes what remains."""

    def __init__(self):
        self.hash, self.state, self.first = hashlib.sha256(), NONE, True

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        self.put(GIVEN[self.state], "")
        self.state = NEXT[self.state]

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.put(role, text)
            self.state = KEEP[self.state][role[0]]
        elif edit == "R":
            self.put(GIVEN[self.state], text)
            self.state = NEXT[self.state]

    def close(self) -> str:
        for _ in tail(self.state):
            self.insert()
        return self.hash.hexdigest()


def solved(rows: list[tuple[int | None, str, str]]) -> dict:
    """RESULT of a conversation's rows (turn, role, text) in order."""
    seen, kinds, codes = set(), bytearray(), [code(r, t) for _, r, t in rows]
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    for (_, role, text), c in zip(rows, codes, strict=True):
        again = (role, text) in seen
        seen.add((role, text))
        kinds.append(kind_of(c, again))
        fault = "blank" if c % 3 == 2 else "duplicate" if again else "truncated" if c % 3 else None
        if fault:
            n[fault] += 1
    audits, states, _ = walk(bytes(kinds), END, [NONE])
    replay, edits = Replay(), iter(audits[0])
    for _, role, text in rows:
        while (e := next(edits)) == "I":
            replay.insert()
        replay.row(e, role, text)
    turns = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **n,
        "illegal": sum(not legal(a // 3, b // 3) for a, b in zip(codes, codes[1:], strict=False)),
        "cost": start_costs(bytes(kinds)), "audit": audits[0] + tail(states[0]), "repaired_sha256": replay.close(),
    }


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(key, "utf-8")) % 20).alias("_k"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.filter("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_k")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_k") == 3, 1).otherwise(0)))).drop("_k", "_copy")


def streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, bits: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Solves the conversations inside the partition; rows of its first and last one, and of long ones, pass through."""
    part = TaskContext.get().partitionId() << 40
    out: list[dict] = []
    now, held, size, through, k = object(), [], 0, True, 0  # through: the conversation's rows pass

    def flush() -> None:
        for at, turn, role, text in held:
            out.append({"conv_id": now, "pos": part + at, "turn": turn, "role": role, "text": text, "code": code(role, text)})
        held.clear()

    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if k == 0 or conv != now:
                if k and not through:
                    out.append({"conv_id": now} | solved([r[1:] for r in held]))
                    held.clear()
                through, size, now = k == 0, 0, conv
            held.append((k, turn, role, text))
            k, size = k + 1, size + len(text)
            through = through or len(held) >= 1 << bits or size > chars
            if through:
                flush()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if k:
        flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mapped(df: DataFrame, make, names: str) -> DataFrame:
    """df with make(row as a dict), a generator of dicts, in place of each row; `names` is the result's schema."""
    schema = df.sparkSession.createDataFrame([], names).schema
    kinds = arrow(schema)

    def over(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if made := list(make(row)):
                    yield pa.RecordBatch.from_pylist(made, kinds)

    return df.mapInArrow(over, schema)


def product(kinds: bytes) -> list[int]:
    """The min-plus product of the rows' matrices, 4 x 4 in a row: least costs from state to state over the block."""
    costs = np.full((CLASSES, 4, 4), FAR, np.int64)
    for kind in range(CLASSES):
        for x in range(4):
            for c, y in by_row(kind, x).values():
                costs[kind, x, y] = min(costs[kind, x, y], c)
        for _ in range(2):
            costs[kind] = np.minimum(costs[kind], INSERT + costs[kind][NEXT])
    m = costs[np.frombuffer(kinds, np.uint8)]
    while len(m) > 1:
        last = m[len(m) // 2 * 2 :]
        m = np.minimum((m[0 : len(m) // 2 * 2 : 2, :, :, None] + m[1::2, None, :, :]).min(axis=2), FAR)
        m = np.concatenate([m, last])
    return m[0].ravel().tolist()


def _block(row: dict) -> Iterator[dict]:
    rows = row["rows"]
    codes, again = [r["code"] for r in rows], [r["again"] for r in rows]
    kinds = bytes(kind_of(c, a) for c, a in zip(codes, again, strict=True))
    n = [sum(c % 3 == 2 for c in codes), sum(a and c % 3 != 2 for c, a in zip(codes, again, strict=True)), sum(c % 3 == 1 and not a for c, a in zip(codes, again, strict=True))]
    yield {
        "_c": row["_c"], "block": row["block"], "first_pos": rows[0]["pos"], "kinds": kinds, "matrix": product(kinds),
        "stats": [*n, sum(not legal(a // 3, b // 3) for a, b in zip(codes, codes[1:], strict=False)), codes[0] // 3, codes[-1] // 3],
    }


def _ends(row: dict) -> Iterator[dict]:
    """Costs after each block, from the last to the first; and the conversation's counts."""
    at, total, blocks = np.array(END), 0, row["blocks"]
    stats = [b["stats"] for b in blocks]
    counts = [sum(s[i] for s in stats) for i in range(4)]
    counts[3] += sum(not legal(a[5], b[4]) for a, b in zip(stats, stats[1:], strict=False))
    ends = []
    for b in reversed(blocks):
        ends.append((b["block"], at.tolist()))
        at = (np.array(b["matrix"]).reshape(4, 4) + at).min(axis=1)
        low = int(at.min())
        at, total = at - low, total + low
    yield {"_c": row["_c"], "cost": total + int(at[NONE]), "counts": counts, "ends": [{"block": k, "end": e} for k, e in ends]}


def _edits(row: dict) -> Iterator[dict]:
    audits, states, _ = walk(row["kinds"], tuple(row["end"]), [0, 1, 2, 3])
    yield {"_c": row["_c"], "block": row["block"], "first_pos": row["first_pos"], "audits": audits, "outs": states}


def _states(row: dict) -> Iterator[dict]:
    state = NONE
    for i, b in enumerate(row["blocks"], 1):
        yield {"_c": row["_c"], "block": b["block"], "state": state, "tail": tail(b["outs"][state]) if i == len(row["blocks"]) else ""}
        state = b["outs"][state]


def _hashes(batches):
    kinds = pa.schema([("_c", pa.string()), ("repaired_sha256", pa.string())])
    now, replay, edits = None, None, iter("")
    for batch in batches:
        done = []
        for c, piece, role, text in zip(*(batch.column(x).to_pylist() for x in ("_c", "piece", "role", "text")), strict=True):
            if c != now:
                if replay:
                    done.append({"_c": now, "repaired_sha256": replay.close()})
                now, replay = c, Replay()
            if piece is not None:
                edits = iter(piece)
            while (e := next(edits)) == "I":
                replay.insert()
            replay.row(e, role, text)
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)
    if replay:
        yield pa.RecordBatch.from_pylist([{"_c": now, "repaired_sha256": replay.close()}], kinds)


def by_blocks(rows: DataFrame, bits: int) -> DataFrame:
    """conv_id and RESULT of the conversations whose rows (with pos and code) these are."""
    c = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = rows.select(c.alias("_c"), "conv_id", "pos", "turn", "role", "text", "code", F.shiftright("pos", bits).alias("block"))
    slim = rows.select("_c", "block", "pos", "code", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_d"))
    first = slim.groupBy("_c", "_d").agg(F.min("pos").alias("_first"))
    slim = slim.join(first, ["_c", "_d"]).select("_c", "block", "pos", "code", (F.col("pos") > F.col("_first")).alias("again"))
    blocks = slim.groupBy("_c", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "again"))).alias("rows"))
    blocks = materialise(mapped(blocks, _block, "_c string, block long, first_pos long, kinds binary, matrix array<long>, stats array<long>"))
    ends = blocks.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "stats"))).alias("blocks"))
    ends = materialise(mapped(ends, _ends, "_c string, cost long, counts array<long>, ends array<struct<block:long,end:array<long>>>"))
    edits = ends.select("_c", F.explode("ends").alias("e")).select("_c", "e.block", "e.end").join(blocks, ["_c", "block"])
    edits = materialise(mapped(edits.select("_c", "block", "first_pos", "kinds", "end"), _edits, "_c string, block long, first_pos long, audits array<string>, outs array<int>"))
    states = edits.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("block", "outs"))).alias("blocks"))
    states = mapped(states, _states, "_c string, block long, state int, tail string")
    pieces = materialise(edits.join(states, ["_c", "block"]).select("_c", "block", F.col("first_pos").alias("pos"), F.concat(F.get("audits", F.col("state")), "tail").alias("piece")))
    audits = pieces.groupBy("_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    rest = rows.groupBy("_c").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    lines = rows.select("_c", "pos", "role", "text").join(pieces.select("_c", "pos", "piece"), ["_c", "pos"], "left")
    hashes = lines.repartition("_c").sortWithinPartitions("_c", "pos").mapInArrow(_hashes, "_c string, repaired_sha256 string")
    n = {x: F.get("counts", F.lit(i)).alias(x) for i, x in enumerate(("blank", "duplicate", "truncated", "illegal"))}
    out = rest.join(ends.select("_c", "cost", *n.values()), "_c").join(audits, "_c").join(hashes, "_c")
    out = materialise(out.select("conv_id", *ZEROS))
    for old in (blocks, ends, edits, pieces):
        release(old)
    return out


def repair(rows: DataFrame, bits: int = BLOCK_BITS, chars: int = HELD_CHARS) -> DataFrame:
    """conv_id and RESULT of every conversation that `rows` (conv_id, turn, role, text; roles and texts not null) hold."""
    # The bounds of ranges are samples of the keys, so a text takes part with a prefix; texts that share it stay together.
    d = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64)))
    d = d.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    names = f"pos long, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, code int, {RESULT}"
    schema = rows.select("conv_id").schema
    for field in rows.sparkSession.createDataFrame([], names).schema:
        schema = schema.add(field)
    kinds = arrow(schema)
    d = materialise(d.mapInArrow(lambda batches: streamed(batches, kinds, bits, chars), schema))
    return d.filter("pos is null").select("conv_id", *ZEROS).unionByName(by_blocks(d.filter("pos is not null"), bits))


def with_empty(results: DataFrame, conversations: DataFrame) -> DataFrame:
    """results, and ZEROS for the conv_ids without one."""
    fill: list[Column] = [F.lit(v).cast("long" if v == 0 else "string").alias(c) for c, v in ZEROS.items()]
    both = results.select("conv_id", F.lit(True).alias("_is"), *ZEROS).unionByName(conversations.select("conv_id", F.lit(False).alias("_is"), *fill))
    best = both.groupBy("conv_id").agg(F.max(F.struct("_is", *ZEROS)).alias("r"))
    return best.select("conv_id", *[F.col("r")[c].alias(c) for c in ZEROS])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_empty(repair(damaged(conversations)), conversations)
