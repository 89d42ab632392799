"""Language ID of code-switched text: a linear-chain CRF labels every word, by forward-backward.

Features of a word: affixes of 1 to 3 letters, character trigrams, and the word itself (lexicon). A line is a chain,
however long. Result columns replace input columns of the same name (compared without case). Null texts and texts without a letter are `und` with score 0; so is everything when
nothing can be learned. The fit uses at most SAMPLE_ROWS rows of any length, drawn per language, and of a longer row
SAMPLE_CHARS characters in pieces spread over the whole text (a documented bound).
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, excerpt, stratified_sample, table, with_outputs

SAMPLE_ROWS, SAMPLE_CHARS, DIM, TOGETHER = 600, 8000, 1 << 16, 1 << 16
_TOKEN = re.compile(r"[^\W\d_]+")


class _Slots(dict):
    """Weight row of a feature name; names recur, so their hashes are kept, up to a bound."""

    def __missing__(self, name: str) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[name] = zlib.crc32(name.encode()) % DIM
        return at


_slots = _Slots()


def word_features(word: str) -> list[int]:
    """Weight rows of a word's distinct features, in an order that depends on the word alone."""
    w = f"^{word}$"
    names = [w, *(f"p{word[:n]}" for n in (1, 2, 3)), *(f"s{word[-n:]}" for n in (1, 2, 3)), *(w[i : i + 3] for i in range(len(w) - 2))]
    return [_slots[n] for n in dict.fromkeys(names)]


#: What a byte does to a CRC-32 state.
_CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def crc_on(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """CRC-32 states after the UTF-8 bytes of one more character (code point) each."""
    out = _CRC[(state ^ code) & 0xFF] ^ (state >> 8)
    for low, high, lead, rest in ((0x80, 0x800, 0xC0, (6, 0)), (0x800, 0x10000, 0xE0, (12, 6, 0)), (0x10000, 0x110000, 0xF0, (18, 12, 6, 0))):
        at = np.flatnonzero((code >= low) & (code < high))
        if not len(at):
            continue
        c, s = code[at], state[at]
        for i, r in enumerate(rest):
            byte = 0x80 | (c >> r & 0x3F) if i else lead | c >> r
            s = _CRC[(s ^ byte) & 0xFF] ^ (s >> 8)
        out[at] = s
    return out


def features_together(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features() of all words one after the other, where each word's begin, and the words for which they do not hold
    and word_features() must be asked: those of one or two letters and those that have a weight row twice."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join([f"^{w}$" for w in words] + ["$$"]).encode("utf-32-le"), np.uint32)
    caret = np.cumsum(n + 2) - n - 2  # of each word in code
    start = np.cumsum(n + 7) - n - 7
    flat = np.empty(int((n + 7).sum()), np.int64)
    none = np.full(len(code), 0xFFFFFFFF, np.uint32)
    flat[start] = [~zlib.crc32(f"^{w}$".encode()) & 0xFFFFFFFF for w in words]
    prefix, suffix = (crc_on(none[: len(n)], np.full(len(n), ord(c), np.uint32)) for c in "ps")
    for k in (1, 2, 3):
        prefix, end = crc_on(prefix, code[caret + k]), suffix
        for back in range(k - 1, -1, -1):
            end = crc_on(end, code[caret + n - back])
        flat[start + k], flat[start + 3 + k] = prefix, end
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at, state = caret[owner] + nth, none[: len(owner)]
    for k in range(3):
        state = crc_on(state, code[at + k])
    flat[start[owner] + 7 + nth] = state
    flat = (flat ^ 0xFFFFFFFF) % DIM
    seen = np.sort(np.repeat(np.arange(len(n)), n + 7) * DIM + flat)
    lone = n < 3
    lone[seen[1:][seen[1:] == seen[:-1]] // DIM] = True
    return flat, start, np.flatnonzero(lone)


def letter_words(line: str) -> list[str]:
    """Runs of letters, in lower case; digits, marks and number forms (as in a superscript two) part words."""
    found, out = _TOKEN.findall(line.lower()), []
    if "".join(found).isalpha():
        return found
    for w in found:
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def chains(text: str | None) -> list[list[str]]:
    """The words of each line: a line is one chain, however long."""
    return [letter_words(line) for line in (text or "").split("\n")]


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chains, words, labels) of padded chains, all chains at once, and where `count`, expected transitions."""
    n, steps, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        step = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step / step.sum(axis=1, keepdims=True), alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        step = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = np.where(mask[:, t + 1, None], step / step.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(steps - 1 if count else 0):
        joint = alpha[:, t, :, None] * a * (e[:, t + 1] * beta[:, t + 1])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pair += joint[mask[:, t + 1]].sum(axis=0)
    return post, pair


def _pad(rows: list[list], k: int) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    emit, mask = np.zeros((len(rows), steps, k)), np.zeros((len(rows), steps), bool)
    for i, r in enumerate(rows):
        emit[i, : len(r)], mask[i, : len(r)] = r, True
    return emit, mask


def fit_crf(texts: list[str], langs: list[str], rounds: int = 3, rate: float = 0.3) -> dict:
    """Weights by AdaGrad on the conditional likelihood; every word of a training text carries the text's language."""
    labels = sorted(set(langs))
    k = len(labels)
    weights, trans = np.zeros((DIM, k)), np.zeros((k, k))
    g_w, g_t = np.full((DIM, k), 1e-3), np.full((k, k), 1e-3)
    data = [(c, labels.index(lang)) for t, lang in zip(texts, langs, strict=True) for c in chains(t)]
    data = [data[i] for i in np.random.default_rng(5).permutation(len(data))]
    feats: dict[str, np.ndarray] = {}
    for _ in range(rounds if k > 1 else 0):
        for lo in range(0, len(data), 32):
            part = [x for x in data[lo : lo + 32] if x[0]]
            if not part:
                continue
            ids = [[feats[w] if w in feats else feats.setdefault(w, np.array(word_features(w))) for w in c] for c, _ in part]
            flat = [f for c in ids for f in c]
            at, owner = np.concatenate(flat), np.repeat(np.arange(len(flat)), [len(f) for f in flat])
            vec = np.zeros((len(flat), k))
            np.add.at(vec, owner, weights[at])
            cut = np.cumsum([0] + [len(c) for c in ids])
            emit, mask = _pad([vec[a:b] for a, b in zip(cut, cut[1:], strict=False)], k)
            post, pair = forward_backward(emit, mask, trans)
            gold = np.zeros((k, k))
            err = post.copy()
            for i, (c, y) in enumerate(part):
                err[i, : len(c), y] -= 1
                gold[y, y] += len(c) - 1
            grad = np.zeros((DIM, k))
            np.add.at(grad, at, err[mask][owner])
            grad, flip = grad / len(part), (pair - gold) / len(part)
            g_w += grad**2
            g_t += flip**2
            weights -= rate * grad / np.sqrt(g_w)
            trans -= 0.1 * rate * flip / np.sqrt(g_t)
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": np.clip(trans, -4, 4)}


def fit_language_id(docs: DataFrame) -> dict:
    known = docs.filter((crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = stratified_sample(known.select("doc_id", excerpt("text", SAMPLE_CHARS).alias("text"), "lang"), "doc_id", SAMPLE_ROWS, "lang")
    got = sorted(got.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit_crf([r["text"] for r in got], [r["lang"] for r in got])


class Tagger:
    """Word posteriors; emissions of words seen before are kept in a bounded cache."""

    def __init__(self, model: dict, cache: int = 150_000):
        self.model, self.limit = model, cache
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model["labels"])), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, labels): rows of a table that grows by doubling and starts anew when over the limit."""
        if len(self.rows) > self.limit:
            self.rows.clear()
        at = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = list(dict.fromkeys([words[i] for i in unknown.tolist()]))
            while len(self.rows) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            flat, starts, lone = features_together(new)
            made = self.table[len(self.rows) : len(self.rows) + len(new)]
            made[:] = np.add.reduceat(self.model["weights"][flat], starts)
            if len(lone):
                asked = [word_features(new[i]) for i in lone.tolist()]
                starts = np.cumsum([0, *map(len, asked[:-1])])
                made[lone] = np.add.reduceat(self.model["weights"][np.fromiter(chain.from_iterable(asked), np.int64)], starts)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            at[unknown] = [self.rows[words[i]] for i in unknown.tolist()]
        return self.table[at]

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the (words, labels) posteriors, in reading order."""
        k = len(self.model["labels"])
        if not k:  # nothing was learned
            return [np.zeros((0, 0)) for _ in texts]
        rows = [(d, c) for d, t in enumerate(texts) for c in chains(t) if c]
        out: list[list] = [[] for _ in texts]
        done: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][1]))
        lo = 0
        while lo < len(order):  # chains of about one length together, so that padding stays small
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(rows[order[hi]][1]) <= TOGETHER and hi - lo < 2048:
                hi += 1
            pick, lo = order[lo:hi], hi
            sizes = np.array([len(rows[i][1]) for i in pick])
            mask = np.arange(sizes[-1]) < sizes[:, None]
            emit = np.zeros((*mask.shape, k))
            emit[mask] = self.emissions([w for i in pick for w in rows[i][1]])
            post = forward_backward(emit, mask, self.model["trans"], count=False)[0]
            for j, i in enumerate(pick):
                done[i] = post[j, : sizes[j]]
        for (d, _), post in zip(rows, done, strict=True):
            out[d].append(post)
        return [np.concatenate(o) if o else np.zeros((0, k)) for o in out]


def language_id(docs: DataFrame, model: dict) -> DataFrame:
    """docs plus lang_pred, score, word_langs (words per language, by each word's most likely label) and certainty.

    certainty is the mean of the words' greatest posteriors: high for code-switched text too, whose score is low, and
    low for words of no learned language. With one learned language it is always 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, word_langs map<string,int>, certainty double>")
    def judge(batches: pd.Series) -> pd.DataFrame:
        tagger, labels, rows = _tagger(held), held.value["labels"], []
        for lo in range(0, len(batches), 512):
            for post in tagger.tag(list(batches.iloc[lo : lo + 512])):
                if not len(post) or not labels:
                    rows.append(("und", 0.0, {}, 0.0))
                    continue
                mean, best = post.mean(axis=0), np.bincount(post.argmax(axis=1), minlength=len(labels))
                rows.append((labels[int(mean.argmax())], round(min(float(mean.max()), 1.0), 9), {x: int(n) for x, n in zip(labels, best, strict=True) if n}, round(min(float(post.max(axis=1).mean()), 1.0), 9)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "word_langs", "certainty"])

    return with_outputs(docs, judge("text"), ["lang_pred", "score", "word_langs", "certainty"])


_held: list = []


def _tagger(broadcast) -> Tagger:
    """One tagger per worker and model, so its cache lives across batches."""
    model = broadcast.value
    if not _held or _held[0].model is not model:
        _held[:] = [Tagger(model)]
    return _held[0]


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_id(docs)
    judged = language_id(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
