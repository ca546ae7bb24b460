"""Quality: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, character n-grams and repetitions of words;
a softmax over two classes reads the average.  Training is stochastic gradient descent
in numpy on a bounded sample of labelled documents.  As everything after the average is linear, a
trained model folds to one number for each bucket, and scoring is a lookup and a mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .toxicity import sampled

#: Labelled documents that a model is fitted on, at most (by hash of the id).
SAMPLE = 6_000
BUCKETS = 1 << 15
DIMENSION = 12
EPOCHS, BATCH, RATE = 8, 64, 0.6
#: Character n-grams, in bytes of the text as it stands: case and signs say much about quality.
GRAMS = (2, 3, 4)
#: Buckets of a word that repeats the one before it, and of one that doesn't.
REPEATED, CHANGED = np.uint64(1), np.uint64(2)
#: How often such a pair counts, next to the dozen n-grams of a word.
WEIGHT = 10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets_of(text: str) -> np.ndarray:
    """Bucket of each word and each character n-gram of a text, words first; n-grams may span blanks."""
    raw = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint64)
    parts = []
    # words: runs between blanks, hashed by a running polynomial whose value at a word's end minus that at its start is the word's own
    blank = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    edge = np.flatnonzero(blank)
    starts, ends = edge[:-1] + 1, edge[1:]
    some = ends > starts
    if some.any():
        values = (raw * np.uint64(0xD6E8FEB86659FD93)) ^ (raw << np.uint64(7))
        place = np.zeros(len(raw), np.uint64)
        # the place of a byte in its word makes the sum depend on order
        run = np.arange(len(raw)) - np.maximum.accumulate(np.where(blank, np.arange(len(raw)), 0))
        place = (run.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * place, dtype=np.uint64)])
        word = total[ends[some]] - total[starts[some]]
        parts.append((word ^ (word >> np.uint64(29))) * _MIX >> np.uint64(64 - 15))
        # of word pairs, only whether a word repeats the one before: which words they are, is said already
        parts.append(np.repeat(np.where(word[1:] == word[:-1], REPEATED, CHANGED), WEIGHT))
    for n in GRAMS:
        if len(raw) >= n:
            key = np.full(len(raw) - n + 1, n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | raw[k : len(raw) - n + 1 + k]
            parts.append((key ^ (key >> np.uint64(17))) * _MIX >> np.uint64(64 - 15))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Folded model: log-odds of label 1 are bias + the mean of `weights` over a document's buckets."""

    weights: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """SGD over (buckets, their shares in the document, label); without both labels the prior alone."""
    labels = np.array([r[2] for r in rows], float)
    if len(rows) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if len(rows) == 0 else 3.0 if labels[0] else -3.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (DIMENSION, 2)).astype(np.float32)
    bias = np.log(np.array([1 - labels.mean(), labels.mean()]) + 1e-6).astype(np.float32)
    squares = np.full(BUCKETS, 1e-6, np.float32)
    total, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            own = [rows[i] for i in order[at : at + BATCH]]
            ids, share = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            sizes = np.array([len(r[0]) for r in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(vectors[ids] * share[:, None], starts, axis=0)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[order[at : at + BATCH]].astype(int)
            p[np.arange(len(own)), y] -= 1
            rate = RATE * (1 - done / total)
            back = p @ out.T
            out -= rate * hidden.T @ p / len(own) * 8
            bias -= 0.05 * rate * p.mean(0)
            # one step for each bucket of the batch, scaled by what it has moved so far, so rare buckets learn too
            slot, where = np.unique(ids, return_inverse=True)
            step = np.zeros((len(slot), DIMENSION), np.float32)
            np.add.at(step, where, np.repeat(back, sizes, axis=0) * share[:, None])
            squares[slot] += (step**2).mean(1)
            vectors[slot] -= rate * step / np.sqrt(squares[slot])[:, None] * 0.5
            done += len(own)
    weights = vectors @ (out[:, 1] - out[:, 0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """A model from at most `bound` labelled documents (their bucket shares, a few hundred KB at most for each, go to the driver)."""
    sample = sampled(docs, labels, label, bound)

    def make():
        def work(ids, texts, marks):
            found = []
            for t in texts:
                slot, n = np.unique(buckets_of(t), return_counts=True)
                found.append((slot.astype("<u2").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            return {"doc_id": ids, "slots": [f[0] for f in found], "shares": [f[1] for f in found], "label": marks}

        return work

    rows = map_texts(sample, make, "doc_id long, slots binary, shares binary, label int", "label").toArrow()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "slots", "shares", "label")), strict=True), key=lambda r: r[0])
    del rows
    return train([(np.frombuffer(s, "<u2").astype(np.int64), np.frombuffer(w, "<f4"), y) for _, s, w, y in got])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (probability of label 1), predicted (score >= threshold) of every row of docs.

    Null and empty texts score by what two blanks say; repeated rows stay repeated; an empty
    table gives an empty result; other columns are not read.
    """
    weights, bias = model.weights, model.bias

    def make():
        def work(ids, texts):
            logit = np.array([bias + weights[buckets_of(t)].mean(dtype=np.float64) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            return {"doc_id": ids, "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

        return work

    return map_texts(docs, make, "doc_id long, score double, predicted int")
