"""Toxicity by multiple-instance learning: sentence probabilities combined by noisy-or, trained from document labels.

Features of a sentence are its distinct words and their beginnings of PREFIXES letters, so that unseen forms of a learned
stem count. Only features of several toxic documents whose counts differ between the labels (G-test of at least MIN_GAIN) take part: the
others would let the fit memorise documents. A fifth of the sample is set aside to place the score at which toxic and
clean documents part best at THRESHOLD; the weights are then fitted again on the whole sample.

Null and empty texts have no sentence and score 0. Without usable labels every text scores 0; of several labels of one
document the greatest counts. Equal texts score equally; repeated rows give repeated results; an empty table gives an
empty result. Columns beyond doc_id and text are not read. The fit uses at most SAMPLE_ROWS labelled documents of any
length, drawn per label, and of a longer one SAMPLE_CHARS characters in pieces spread over the whole text (a documented
bound of the classifier's sample); scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, excerpt, stratified_sample, table

SAMPLE_ROWS, SAMPLE_CHARS, PIECES = 4000, 20_000, 20
PREFIXES, MIN_DOCS, MIN_GAIN = (3, 4, 5, 6), 4, 15.0
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+|\n|$)")
_TOKEN = re.compile(r"[^\W\d_]+")


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def gain(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """The G statistic of a feature that pos of n_pos toxic and neg of n_neg clean documents hold."""
    total, out = n_pos + n_neg, 0.0
    for seen, row, col in ((pos, pos + neg, n_pos), (neg, pos + neg, n_neg), (n_pos - pos, total - pos - neg, n_pos), (n_neg - neg, total - pos - neg, n_neg)):
        if seen:
            out += 2 * seen * np.log(seen * total / (row * col))
    return out


def fit_weights(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.1, l2: float = 0.05) -> dict:
    """Feature weights and bias maximising the noisy-or likelihood of document labels, by Adam on the whole sample."""
    def bag(text: str) -> list[set[str]]:
        return [{f for w in set(_TOKEN.findall(text[a:b].lower())) for f in word_features(w)} for a, b in sentence_spans(text)]

    n_pos, pos, neg = sum(labels), Counter(), Counter()
    n_neg = len(labels) - n_pos
    for t in (t for t, y in zip(texts, labels, strict=True) if y):
        pos.update(set().union(*bag(t)))
    pos = Counter({f: n for f, n in pos.items() if n > 1})
    for t in (t for t, y in zip(texts, labels, strict=True) if not y):
        neg.update(f for f in set().union(*bag(t)) if f in pos)
    vocab = [f for f, n in pos.items() if n + neg[f] >= MIN_DOCS and gain(n, neg[f], n_pos, n_neg) >= MIN_GAIN]
    vocab = {f: i for i, f in enumerate(sorted(vocab))}
    if not vocab or not n_pos or not n_neg:
        return {"bias": -30.0, "shift": 0.0, "weights": {}}
    sent, feature, doc = [], [], []
    for d, text in enumerate(texts):
        for s in bag(text):
            ids = [vocab[f] for f in sorted(s) if f in vocab]
            sent += [len(doc)] * len(ids)
            feature += ids
            doc.append(d)
    sent, feature, doc, y = np.array(sent, int), np.array(feature, int), np.array(doc, int), np.array(labels, float)
    theta, m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    theta[-1] = -6.0
    for step in range(1, steps + 1):
        z = np.bincount(sent, theta[feature], len(doc)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        # d(-log likelihood)/dz: negatives push each sentence by p, positives pull by p * P(none) / P(some).
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)[doc] * p
        grad = np.append(np.bincount(feature, pull[sent], len(vocab)), pull.sum()) + l2 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"bias": float(theta[-1]), "shift": 0.0, "weights": {f: float(theta[i]) for f, i in vocab.items() if abs(theta[i]) > 1e-3}}


def best_cut(scores: list[float], labels: list[int]) -> float:
    """The log odds, in the widest of the best gaps, at which recall and twice the specificity add up to most."""
    z = np.log(np.clip(scores, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(scores, 1e-9, 1 - 1e-9))
    order = np.argsort(-z, kind="stable")
    z, y = z[order], np.array(labels)[order]
    value = np.cumsum(y) / max(y.sum(), 1) - 2 * np.cumsum(1 - y) / max((1 - y).sum(), 1)
    value[:-1][z[:-1] == z[1:]] = -np.inf
    ends = np.append(z[1:], z[-1] - 1)
    at = max(np.flatnonzero(value == value.max()), key=lambda i: z[i] - ends[i])
    return float((z[at] + ends[at]) / 2)


def fit_noisy_or(texts: list[str], labels: list[int]) -> dict:
    """fit_weights on the whole sample, its scores shifted so that the best cut of the part set aside is THRESHOLD."""
    aside = [zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0 for t in texts]
    kept = [(t, y) for t, y, a in zip(texts, labels, aside, strict=True) if not a]
    test = [(t, y) for t, y, a in zip(texts, labels, aside, strict=True) if a]
    model = fit_weights(texts, labels)
    if model["weights"] and len({y for _, y in test}) == 2:
        trial = fit_weights([t for t, _ in kept], [y for _, y in kept])
        if trial["weights"]:
            cut = best_cut([noisy_or([p for *_, p in sentence_scores(t, trial)]) for t, _ in test], [y for _, y in test])
            model["shift"] = float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


class _Weights(dict):
    """The weight of a word, from the weights of its features; kept, up to a bound, for words seen before."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        weights = self.model["weights"]
        out = self[word] = sum(weights[f] for f in word_features(word) if f in weights)
        return out


def sentence_scores(text: str | None, model: dict, words: _Weights | None = None) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence with a word. A sentence's beginnings count once."""
    words, bias, out = _Weights(model) if words is None else words, model["bias"], []
    for a, b in sentence_spans(text):
        found = {w for w in _TOKEN.findall(text[a:b].lower()) if words[w]}
        if len(found) > 1:
            z = sum(model["weights"].get(f, 0.0) for f in sorted({f for w in found for f in word_features(w)}))
        else:
            z = sum(words[w] for w in found)
        out.append((a, b, 1 / (1 + float(np.exp(-max(min(z + bias, 30), -30))))))
    return out


def noisy_or(scores: list[float], shift: float = 0.0) -> float:
    """The probability that some sentence is toxic, its log odds moved by shift."""
    if not scores:
        return 0.0
    none = float(np.sum(np.log1p(-np.minimum(scores, 1 - 1e-12))))
    some = float(-np.expm1(none))
    return 0.0 if some <= 0 else 1 / (1 + float(np.exp(none - shift)) / some)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on labelled rows outside the held-out third; the sample is collected, its size bounded by the two limits."""
    known = labels.filter(crc_mod("doc_id", 3) != 1).filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stratified_sample(known, "doc_id", SAMPLE_ROWS, "toxic")
    rows = docs.select("doc_id", excerpt("text", SAMPLE_CHARS, PIECES).alias("text")).filter("text is not null").join(F.broadcast(known), "doc_id")
    got = bounded_sample(rows, "doc_id", SAMPLE_ROWS).collect()
    return fit_noisy_or([r["text"] for r in got], [int(r["toxic"]) for r in got])


def toxicity(docs: DataFrame, model: dict, at: float = 0.5) -> DataFrame:
    """doc_id, score, and the offending sentences: array<struct<start, end, score>> of those scoring `at` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = _Weights(held.value)
        for b in batches:
            found = [sentence_scores(t, held.value, words) for t in b["text"]]
            bad = [[{"start": s, "end": e, "score": p} for s, e, p in f if p >= at] for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [noisy_or([p for *_, p in f], held.value["shift"]) for f in found], "sentences": bad})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, sentences array<struct<start int, end int, score double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")
