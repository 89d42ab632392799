"""SentencePiece encoding as a weighted transducer: normaliser, pieces and byte fallback, and a tropical shortest path.

The machine is compiled once per worker into arrays: an input symbol is a byte, or META, which the normaliser writes for a
space and puts in front of the text. A piece is a path of the trie and costs ln(rank + 2), rank being the piece's place
in the vocabulary file (Zipf weights: the file's merge scores are ranks, not log probabilities); any byte alone is an arc
of BYTE_COST. A meta symbol that is already in the text stays three bytes, so decode(encode(text)) == text for every text.
The path with the least sum wins, and of equal sums the longer last arc.

No piece holds META after another symbol, so a text's lattice falls apart at each run of META; the best path is the chain
of the parts' best paths. The machine is composed with all new parts of a batch at once: every position walks the trie in
step with the others, and the arcs found are relaxed by start offset. Parts seen before come from a bounded table by
64-bit hash; every result is decoded and compared, and a text that differs is encoded anew without the table.

Null and empty texts give no ids; an empty table gives an empty result. Result columns replace input columns of the same
name (compared without case). The vocabulary path is a parameter; the file (about 0.5 MB, checked) is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_prefix, set_aside, table, with_outputs
from .shingles import _BYTES, _powers, mix

META, META_SYMBOL = "▁", 256
BYTE_COST = 14.0
MAX_VOCAB_BYTES = 16 << 20
CHUNK, LONG_PART, KNOWN_PARTS = 1 << 18, 48, 300_000
ROWS = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCAB_BYTES} bytes")
    return data


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Transducer:
    def __init__(self, model: bytes, known: int = KNOWN_PARTS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int64)
        written: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                written.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                written.append(b"")
            else:
                written.append(piece.replace(META, " ").encode())
                if META not in piece.lstrip(META):
                    self.pieces[piece] = (i, math.log(i + 2))
        self.out = np.frombuffer(b"".join(written), np.uint8)
        self.out_size = np.array([len(w) for w in written], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self._compile()
        if self.pieces and max(cost for _, cost in self.pieces.values()) >= BYTE_COST:
            raise ValueError("a byte must cost more than any piece")
        self.limit = known
        self.normal = np.arange(256, dtype=np.int16)
        self.normal[ord(" ")] = META_SYMBOL
        self._forget()

    def _compile(self) -> None:
        """The trie as a hash table of arcs (state, symbol) -> state, and per state the piece that ends there."""
        arcs: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for piece, hit in self.pieces.items():
            metas = len(piece) - len(piece.lstrip(META))
            state = 0
            for s in [META_SYMBOL] * metas + list(piece[metas:].encode()):
                state = arcs.setdefault(state << 9 | s, len(arcs) + 1)
            ends[state] = hit
        self.piece_at = np.full(len(arcs) + 1, -1, np.int64)
        self.cost_at = np.full(len(arcs) + 1, np.inf)
        for state, (i, cost) in ends.items():
            self.piece_at[state], self.cost_at[state] = i, cost
        self.shift = np.uint64(64 - max((len(arcs) * 8).bit_length(), 4))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.next = np.zeros(len(self.slots), np.int64)
        keys, states = np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.slots[at[take]], self.next[at[take]] = keys[take], states[take]
            left = np.ones(len(keys), bool)
            left[take] = False
            keys, states, at = keys[left], states[left], (at[left] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is no arc."""
        keys = state << 9 | symbol.astype(np.int64)
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.next[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.next[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def shortest_paths(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths of parts that lie one after the other in symbols; and the number of ids of each."""
        parts = len(size)
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(parts), size)
        node = np.arange(len(symbols)) + part  # every part has one node more than symbols
        offset = np.arange(len(symbols)) - start[part]
        left = size[part] - offset
        # Compose: all positions walk the trie together.
        at, state, reach = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        found = []
        while len(at):
            state = self.step(state, symbols[at + reach])
            reach += 1
            go = state >= 0
            at, state = at[go], state[go]
            end = self.piece_at[state] >= 0
            found.append((at[end], np.full(int(end.sum()), reach), state[end]))
            go = left[at] > reach
            at, state = at[go], state[go]
        src, length, state = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        a_from, a_to, a_cost, a_id = node[src], node[src] + length, self.cost_at[state], self.piece_at[state]
        b_id = self.byte_ids[np.where(symbols == META_SYMBOL, ord(" "), symbols)]
        # Relax by start offset, so a node is final before arcs leave it; a later equal sum does not replace an earlier.
        cost = np.full(len(symbols) + parts, np.inf)
        cost[start + np.arange(parts)] = 0.0
        back, ids = np.zeros(len(cost), np.int64), np.zeros(len(cost), np.int64)
        longest = int(size.max()) if parts else 0
        turns = offset.astype(np.uint16) if longest < 1 << 16 else offset  # short keys sort faster
        order = np.argsort(turns[src], kind="stable")
        # A byte costs more than any piece, so its arc is of use only where no piece takes the symbol alone.
        bare = np.ones(len(symbols), bool)
        bare[src[length == 1]] = False
        bare = np.flatnonzero(bare)
        by_src = bare[np.argsort(turns[bare], kind="stable")]
        cut_a = np.concatenate([[0], np.cumsum(np.bincount(turns[src], minlength=longest))])
        cut_b = np.concatenate([[0], np.cumsum(np.bincount(turns[bare], minlength=longest))])
        a_from, a_to, a_cost, a_id = a_from[order], a_to[order], a_cost[order], a_id[order]
        for o in range(longest):
            e = slice(cut_a[o], cut_a[o + 1])
            to, new = a_to[e], cost[a_from[e]] + a_cost[e]
            ok = new < cost[to]
            to = to[ok]
            cost[to], back[to], ids[to] = new[ok], a_from[e][ok], a_id[e][ok]
            p = by_src[cut_b[o] : cut_b[o + 1]]
            q = node[p]
            new = cost[q] + BYTE_COST
            ok = new < cost[q + 1]
            q, p = q[ok], p[ok]
            cost[q + 1], back[q + 1], ids[q + 1] = new[ok], q, b_id[p]
        # Trace all parts back together.
        cur, who = start + np.arange(parts) + size, np.arange(parts)
        first = start + np.arange(parts)
        steps = []
        go = cur > first
        while go.any():
            cur, who = cur[go], who[go]
            steps.append((who, ids[cur]))
            cur = back[cur]
            go = cur > first[who]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(parts, np.int64)
        who, got = np.concatenate([w for w, _ in steps]), np.concatenate([g for _, g in steps])
        turn = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
        count = np.bincount(who, minlength=parts)
        out = np.empty(len(got), np.int64)
        out[(np.cumsum(count) - 1)[who] - turn] = got
        return out, count

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_start = self.known_size = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def _encode(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """shortest_paths in the order of the parts; parts of about one length together, so steps are few and full."""
        ids, counts, where = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order, done = np.argsort(size, kind="stable"), 0
        lo = 0
        while lo < len(order):
            hi = max(int(np.searchsorted(size[order], max(size[order[lo]] * 2, LONG_PART // 2), side="right")), lo + 1)
            pick = order[lo:hi]
            got, n = self.shortest_paths(symbols[_slices(start[pick], size[pick])], size[pick])
            counts[pick], where[pick] = n, done + np.cumsum(n) - n
            ids.append(got)
            done += len(got)
            lo = hi
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return flat[_slices(where, counts)].astype(np.int32), counts

    def encode_bytes(self, raw: list[bytes], remember: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each. Empty texts have none."""
        full = [i for i, r in enumerate(raw) if r]
        counts = np.zeros(len(raw), np.int64)
        if not full:
            return np.zeros(0, np.int32), counts
        symbols = self.normal[np.frombuffer(b" " + b" ".join(raw[i] for i in full), np.uint8)]
        texts = np.cumsum([0] + [len(raw[i]) + 1 for i in full])
        meta = symbols == META_SYMBOL
        head = meta & ~np.concatenate([[False], meta[:-1]])
        head[texts[:-1]] = True
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(symbols)))
        if remember:
            up, down = _powers(1 << max((len(symbols) - 1).bit_length(), 19))
            sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum((_BYTES[symbols & 255] ^ (symbols >> 8).astype(np.uint64)) * up[: len(symbols)], out=sums[1:])
            keys = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
            uniq, first, which = np.unique(keys, return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, uniq)
            new = np.ones(len(uniq), bool)
            new[at < len(self.known)] = self.known[at[at < len(self.known)]] != uniq[at < len(self.known)]
            if new.any():
                if len(self.known) + int(new.sum()) > self.limit:
                    self._forget()
                    new[:] = True
                ids, n = self._encode(symbols, start[first[new]], size[first[new]])
                keys, starts = np.concatenate([self.known, uniq[new]]), np.concatenate([self.known_start, len(self.known_ids) + np.cumsum(n) - n])
                order = np.argsort(keys, kind="stable")
                self.known, self.known_start, self.known_size = keys[order], starts[order], np.concatenate([self.known_size, n])[order]
                self.known_ids = np.concatenate([self.known_ids, ids])
            at = np.searchsorted(self.known, uniq)[which]
            n = self.known_size[at]
            flat = self.known_ids[_slices(self.known_start[at], n)]
        else:
            flat, n = self._encode(symbols, start, size)
        total = np.concatenate([[0], np.cumsum(n)])
        cut = total[np.searchsorted(start, texts)]
        counts[full] = np.diff(cut)
        return flat, counts

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """What the ids write, with the leading space."""
        return self.out[_slices(self.out_start[ids], self.out_size[ids])]

    def encode_texts(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, number of ids per text, whether decoding gives the text back) of runs of texts of about CHUNK bytes."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        lo = 0
        while lo < len(raw):
            hi, size = lo + 1, len(raw[lo])
            while hi < len(raw) and size + len(raw[hi]) < CHUNK:
                size += len(raw[hi])
                hi += 1
            part = raw[lo:hi]
            ids, counts = self.encode_bytes(part)
            if self.decode_bytes(ids).tobytes() == b"".join(b" " + r for r in part if r):
                yield ids, counts, np.ones(len(part), bool)
            else:  # two parts of one hash
                self._forget()
                got = [self.encode_bytes([r], remember=False)[0] for r in part]
                same = [self.decode_bytes(g).tobytes() == (b" " + r if r else b"") for g, r in zip(got, part, strict=True)]
                yield np.concatenate(got), np.array([len(g) for g in got]), np.array(same)
            lo = hi

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_texts([text]))[0].tolist()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes()[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _transducer(model: bytes) -> Transducer:
    return Transducer(model)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """docs plus token_ids, n_tokens and round_trip (decoding gives the text back; null text counts as empty)."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))

    names = ["token_ids", "n_tokens", "round_trip"]
    rows, back = set_aside(docs.withColumn(free_prefix(docs) + "text", F.col(text)), [], names)
    rows = rows.select(*back)
    kept, at = rows.columns[:-1], rows.columns[-1]
    schema = StructType([*rows.drop(at).schema.fields, *StructType.fromDDL("token_ids array<int>, n_tokens bigint, round_trip boolean").fields])

    def run(batches):
        t = _transducer(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                made = list(t.encode_texts(part.column(at).to_pylist()))
                ids, counts, same = (np.concatenate([m[i] for m in made]) for i in range(3))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, pa.array(counts), pa.array(same)], names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, ids: str = "token_ids") -> DataFrame:
    """encoded plus decoded; null ids decode to an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        t = _transducer(held.value)
        return pd.Series([t.decode(r) if r is not None else "" for r in rows])

    at = free_prefix(encoded) + "ids"
    return with_outputs(encoded.withColumn(at, F.col(ids)), F.struct(run(F.col(at)).alias("decoded")), ["decoded"]).drop(at)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", "round_trip", "token_ids")
