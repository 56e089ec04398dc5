"""Operator 10, toxicity: character n-grams scaled by naive Bayes log-count ratios.

Features are hashed strings of characters (code points, case folded up to U+024F), present
or not: all of ``ORDERS`` characters, and those of ``WORD_ORDERS`` characters at the
beginning of a word, which hold whole words. Their log-count ratios come from all learnable labelled
documents; the ``FEATURES`` strings with the most significant ratios (z of ``LEAST_Z`` or
more) are kept, which is the model's size and not a cap on what is read, and a logistic
regression on the ratio-scaled features is fitted on at most ``TRAIN_ROWS`` labelled
rows (in the order of a hash of their id).

Null or empty text: no features, the score of the bias. No labels, or labels of one
class: the smoothed share of that label for every row. Very long texts are hashed in
pieces that overlap by 10 characters. Null ids are scored and in no fold, so never learnt;
repeated ids with one label are learnt once. Repeated rows and ties stay and get equal
scores. A column named like the score gives way to it; other extra columns stay. Empty
table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.classify import block_rows, fold, labelled, sigmoid, summed_blocks, training_rows, with_score
from relquill.llm.common import column, document_slices, documents, gram_values, prefix_hash, released, span_values, text_bytes

ORDERS, WORD_ORDERS, SLOTS, BLOCK = (3, 4, 5, 6), tuple(range(6, 12)), 1 << 18, 1 << 12
TRAIN_ROWS, FEATURES, LEAST_Z = 16_384, 4096, 2.5
SLICE, PIECE = 1 << 19, 1 << 19
FOLDS, HELD, THRESHOLD = 3, 1, 0.7

#: Lower case of the code points below U+0250.
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered code points of some documents, and where each begins among them."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:  # bytes that are no text are replaced, document by document
        parts = [raw[i:j].decode(errors="replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        points, ends = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, parts)])
    return np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points), ends


def gram_slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of every n-gram of some documents, order by order."""
    data, offsets = characters(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    # a word begins after a sign, after white space, or with its document
    inside = (data >= 128) | (data >= 97) & (data < 123) | (data >= 48) & (data < 58)
    begins = inside & np.concatenate([[True], ~inside[:-1]]) if len(data) else inside
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    for at in range(0, max(1, len(data)), PIECE):
        piece = data[at : at + PIECE + max(WORD_ORDERS) - 1]
        prefix = prefix_hash(piece)
        words = np.flatnonzero(begins[at : at + PIECE])
        for k in (*ORDERS, *(-k for k in WORD_ORDERS)):
            # grams that would run into the next document are none
            if k > 0:
                n = max(0, min(PIECE, len(piece) - k + 1))
                own = np.flatnonzero(last[at : at + n] >= np.arange(at + k, at + k + n))
                value = gram_values(prefix, k)[own]
            else:
                own = words[words - k <= len(piece)]
                own = own[at + own - k <= last[at + own]]
                value = span_values(prefix, own, own - k)
            slot = ((value + np.uint64(k % 64)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
            yield row[at + own], slot.view(np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(texts)
    for a, b in document_slices(offsets, SLICE):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios, their z-scores and (negatives, positives), from (text, y) rows."""
    width = 2 * SLOTS + BLOCK  # a last block holds the number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        stamp, number = np.zeros(SLOTS, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            y = (column(batch, "y").to_numpy() > 0).astype(np.int64)
            for c in (0, 1):
                total[2 * SLOTS + c] += int((y == c).sum())
            for a, b, data, offsets in slices(column(batch, "text")):
                held: list[list[np.ndarray]] = [[] for _ in range(b - a)]
                for doc, slot in gram_slots(data, offsets):
                    cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                    for d in range(b - a):
                        held[d].append(slot[cut[d] : cut[d + 1]])
                for d in range(b - a):
                    own = np.concatenate(held[d])
                    if len(own) > len(number):
                        number = np.arange(2 * len(own))
                    # each slot once: where its last entry stands
                    stamp[own] = number[: len(own)]
                    total[y[a + d] * SLOTS + own[stamp[own] == number[: len(own)]]] += 1
        while (part := np.minimum(total, 2**31 - 1)).any():
            yield block_rows(part, BLOCK)
            total -= part

    total = np.zeros(width, np.float64)
    for block, body in summed_blocks(rows.select("text", "y").mapInArrow(released(run), "block long, body binary")).items():
        total[block * BLOCK : (block + 1) * BLOCK] = body
    negative, positive, n = total[:SLOTS] + 1, total[SLOTS : 2 * SLOTS] + 1, total[2 * SLOTS : 2 * SLOTS + 2]
    ratio = np.log(positive / (n[1] + 2)) - np.log(negative / (n[0] + 2))
    return ratio, ratio / np.sqrt(1 / positive + 1 / negative), n


def chosen_slots(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the kept features that occur, once each; ``place`` is -1 for the rest."""
    codes = []
    for doc, slot in gram_slots(data, offsets):
        at = place[slot]
        hit = at >= 0
        codes.append(np.unique(doc[hit] * FEATURES + at[hit]))
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    return code // FEATURES, code % FEATURES


class Model:
    """Places of the kept slots, their weights (ratio included) and a bias."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float):
        self.place, self.weight, self.bias = place, weight, bias

    def probability(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b, data, offsets in slices(texts):
            doc, at = chosen_slots(data, offsets, self.place)
            out[a:b] += np.bincount(doc, self.weight[at], b - a)
        return sigmoid(out)


def fit(row: np.ndarray, at: np.ndarray, scale: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2 logistic regression on sparse features ``scale[at]``, by accelerated gradient steps."""
    n, m = len(y), len(scale)
    value = scale[at]
    w, look, bias, bias_look, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    # a bound on the curvature: a quarter of the mean squared row norm, at its largest
    norm = np.bincount(row, value**2, n)
    rate = 1 / (0.25 * (np.percentile(norm, 99) + 1) + 1e-6)
    for _ in range(steps):
        err = (sigmoid(np.bincount(row, value * look[at], n) + bias_look) - y) / n
        grad = np.bincount(at, value * err[row], m) + 1e-5 * look
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_next, bias_next = look - rate * grad * 4, bias_look - err.sum() * 4
        look, bias_look = w_next + (t - 1) / t_next * (w_next - w), bias_next + (t - 1) / t_next * (bias_next - bias)
        w, bias, t = w_next, bias_next, t_next
    return w, bias


def train(docs: DataFrame, labels: DataFrame, known, label: str = "toxic") -> Model:
    ratio, z, n = log_count_ratios(labelled(docs, labels, label, known))
    place = np.full(SLOTS, -1, np.int64)
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(place, np.zeros(FEATURES), float(np.log(share / (1 - share))))
    kept = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    kept = np.sort(kept[np.abs(z[kept]) >= LEAST_Z])
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def features(texts: pa.Array) -> list[bytes]:
        found = []
        for a, b, data, offsets in slices(texts):
            doc, at = chosen_slots(data, offsets, shared.value)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            found += [at[i:j].astype(np.uint16).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return found

    rows = training_rows(labelled(docs, labels, label, known, TRAIN_ROWS), features)
    sizes = np.array([len(r["x"]) // 2 for r in rows], np.int64)
    at = np.frombuffer(b"".join(r["x"] for r in rows), np.uint16).astype(np.int64)
    scale = np.zeros(FEATURES)
    scale[: len(kept)] = ratio[kept]
    w, bias = fit(np.repeat(np.arange(len(rows)), sizes), at, scale, np.array([r["y"] > 0 for r in rows], np.float64))
    return Model(place, w * scale, bias)


def scored(docs: DataFrame, labels: DataFrame, known, name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxic 1 as column ``name``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, known))
    return with_score(docs, lambda texts: model.value.probability(texts), name)


def learnable(doc_id):
    return fold(doc_id, FOLDS) != HELD


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(rows, documents(spark, sf_dir, "labels"), learnable)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
