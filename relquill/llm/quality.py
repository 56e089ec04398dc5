"""Operator 5, quality classifier on random-indexing word vectors.

Every hashed word has a fixed sparse ternary index vector; its word vector is the
sum of the index vectors of the words around it, counted over the whole corpus.
A document is the mean of its words' vectors, once plain and once with frequent
words weighed down. A two-layer numpy network is trained on at most
``TRAIN_ROWS`` labelled rows (in the order of a hash of their id) and its
probabilities are calibrated by a temperature fitted on rows it was not trained on.

Words are runs of letters and digits, or runs of signs, hashed into ``vocab`` slots
(``VOCAB`` unless given), so vectors and what executors send are of fixed size; words that
share a slot share a vector, and a corpus of more distinct words than slots is told apart by
its frequent ones. Each task sends (DIMS + 1) * 4 bytes a slot that it met.
Null or empty text: the zero vector, whose score is the network's. Very long texts: one
slice each. No labels, or labels of one class: the smoothed share of that label, for every
row. Null ids are scored and in no fold, so never learnt; repeated ids with one label are learnt
once. Repeated rows and ties stay and get equal scores. A column named like the score gives
way to it; other extra columns stay. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.classify import block_rows, fold, labelled, sigmoid, summed_blocks, training_rows, with_score
from relquill.llm.common import column, document_slices, documents, prefix_hash, span_hashes, text_bytes

VOCAB, DIMS, NONZERO, REACH, BLOCK = 1 << 13, 32, 6, 2, 64
TRAIN_ROWS, HIDDEN, EPOCHS = 20_000, 32, 40
SLICE = 1 << 20
FOLDS, THRESHOLD = 5, 0.3

_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_vectors(vocab: int = VOCAB) -> np.ndarray:
    """(vocab + 1, DIMS) sparse ternary vectors; the last slot, between documents, is zero."""
    rng = np.random.default_rng(20)
    out = np.zeros((vocab + 1, DIMS), np.int8)
    for v in range(vocab):
        out[v, rng.choice(DIMS, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    return out


def word_slots(data: np.ndarray, offsets: np.ndarray, vocab: int = VOCAB) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word of some documents, and the words before each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = span_hashes(prefix_hash(data), starts, ends)
    return (h % np.uint64(vocab)).astype(np.int64), np.searchsorted(starts, offsets)


def slices(texts: pa.Array, vocab: int = VOCAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, word slots, words before each row) in bounded pieces."""
    data, offsets = text_bytes(texts)
    for a, b in document_slices(offsets, SLICE):
        yield (a, b, *word_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocab))


def word_vectors(docs: DataFrame, vocab: int = VOCAB) -> tuple[np.ndarray, np.ndarray]:
    """(vocab, DIMS) unit word vectors and the words' shares, from all documents."""
    width = DIMS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(vocab)
        total = np.zeros((vocab, width), np.int64)
        for batch in batches:
            for a, b, slot, first in slices(column(batch, "text"), vocab):
                # REACH empty slots between documents keep contexts apart
                doc = np.searchsorted(first[1:], np.arange(len(slot)), side="right")
                padded = np.full(len(slot) + REACH * (b - a + 1), vocab)
                place = np.arange(len(slot)) + REACH * (doc + 1)
                padded[place] = slot
                around = np.zeros((len(padded), DIMS), np.int8)
                vec = index[padded]
                for d in range(1, REACH + 1):
                    around[d:] += vec[:-d]
                    around[:-d] += vec[d:]
                near = around[place]
                for d in range(DIMS):
                    total[:, d] += np.bincount(slot, near[:, d], vocab).astype(np.int64)
                total[:, DIMS] += np.bincount(slot, minlength=vocab)
        while (part := np.clip(total, -(2**31) + 1, 2**31 - 1)).any():
            yield block_rows(part.ravel(), BLOCK * width)
            total -= part

    sums = summed_blocks(docs.select("text").mapInArrow(run, "block long, body binary"))
    out = np.zeros((vocab, width), np.float64)
    for block, body in sums.items():
        out[block * BLOCK : (block + 1) * BLOCK] = body.reshape(BLOCK, width)
    count, vectors = out[:, DIMS], out[:, :DIMS]
    # less what the corpus has around any word
    vectors = vectors - count[:, None] * (vectors.sum(axis=0) / max(1.0, count.sum()))
    # and, with the context, the word itself
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) + index_vectors(vocab)[:vocab] / np.sqrt(NONZERO)
    return vectors.astype(np.float32), count / max(1.0, count.sum())


def pooled(texts: pa.Array, vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(rows, 2 * DIMS): the plain mean and that with rare words weighed up."""
    rare = (1e-3 / (1e-3 + share)).astype(np.float32)
    both = np.concatenate([vectors, vectors * rare[:, None]], axis=1)
    out = np.zeros((len(texts), both.shape[1]), np.float32)
    for a, b, slot, first in slices(texts, len(vectors)):
        some = np.flatnonzero(np.diff(first))
        if len(some):
            sums = np.add.reduceat(both[slot], first[:-1][some], axis=0)
            out[a + some] = sums / np.diff(first)[some][:, None]
    return out


class Network:
    """64 inputs, one hidden layer, one calibrated probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(5)
        self.temperature, self.prior = 1.0, (y.sum() + 1) / (len(y) + 2)
        self.flat = len(y) < 20 or y.min() == y.max()
        if self.flat:
            return
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        self.w1 = rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN))
        self.w2 = rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN + 1)
        weights = [self.w1, self.w2]
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(EPOCHS):
            own = rng.permutation(own)
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            for k in range(0, len(own), 256):
                i = own[k : k + 256]
                pre = z[i] @ self.w1
                hid = np.concatenate([np.maximum(pre, 0), np.ones((len(i), 1))], axis=1)
                err = (sigmoid(hid @ self.w2) - y[i]) / len(i)
                grads = [z[i].T @ (np.outer(err, self.w2[:-1]) * (pre > 0)) + 1e-4 * self.w1, hid.T @ err + 1e-4 * self.w2]
                step += 1
                for w, g, mm, vv in zip(weights, grads, m, v, strict=True):
                    mm *= 0.9
                    mm += 0.1 * g
                    vv *= 0.999
                    vv += 0.001 * g * g
                    w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        logit = self.logits(x[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        return np.concatenate([np.maximum(z @ self.w1, 0), np.ones((len(x), 1))], axis=1) @ self.w2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.flat else sigmoid(self.logits(x) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, known, label: str = "quality", vocab: int = VOCAB) -> tuple[np.ndarray, np.ndarray, Network]:
    vectors, share = word_vectors(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, share))

    rows = training_rows(labelled(docs, labels, label, known, TRAIN_ROWS), lambda texts: [r.tobytes() for r in pooled(texts, *shared.value)])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, 2 * DIMS)
    return vectors, share, Network(x, np.array([r["y"] for r in rows], np.float64))


def scored(docs: DataFrame, labels: DataFrame, known, name: str = "score", vocab: int = VOCAB) -> DataFrame:
    """``docs`` with the probability of quality 1 as column ``name``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, known, vocab=vocab))
    return with_score(docs, lambda texts: model.value[2].probability(pooled(texts, *model.value[:2])), name)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(rows, documents(spark, sf_dir, "labels"), lambda k: fold(k, FOLDS) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
