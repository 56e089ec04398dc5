"""What the two classifiers share: labelled rows, block sums, appended scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relquill.llm.common import column, plain_names, released

#: Labels are broadcast up to this many rows (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, known: Callable[[Column], Column], at_most: int | None = None) -> DataFrame:
    """(k, text, y) of labelled documents, k their id. ``known`` tells, from a doc_id, which labels may be
    learnt; ``at_most`` bounds their number, taken in the order of a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter(known(F.col("k")) & F.col("y").isNotNull())
    if at_most:
        rows = rows.orderBy(F.xxhash64("k"), "k", "y").limit(at_most)
    if at_most and at_most <= BROADCAST_LABELS or rows.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        rows = F.broadcast(rows)
    return docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(rows, F.col("d") == F.col("k")).select("k", "text", "y")


def training_rows(rows: DataFrame, featured: Callable[[pa.Array], list[bytes]]) -> list:
    """(x, y) of (k, text, y) rows, x the bytes that ``featured`` makes of each text, sorted.

    Rows of one id and label are one: of their features the least are taken, so no more
    rows reach the driver than labels were asked for, however often an id is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([column(batch, "k"), pa.array(featured(column(batch, "text")), pa.binary()), column(batch, "y")], names=["k", "x", "y"])

    each = rows.mapInArrow(released(run), "k long, x binary, y int").groupBy("k", "y").agg(F.min("x").alias("x"))
    return sorted(each.select("x", "y").collect())


def summed_blocks(rows: DataFrame) -> dict[int, np.ndarray]:
    """Element-wise sums of int64 vectors by block: (block long, body binary) rows, streamed.

    The number and size of blocks are fixed by the caller, so what reaches the driver is too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def ended() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "body"])

        for batch in batches:
            bodies = column(batch, "body")
            for i, k in enumerate(column(batch, "block").to_pylist()):
                body = np.frombuffer(bodies[i].as_buffer(), np.int32)
                if k != key:
                    if key is not None:
                        yield ended()
                    key, total = k, np.zeros(len(body), np.int64)
                total += body
        if key is not None:
            yield ended()

    done = rows.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(released(run), "block long, body binary")
    return {r["block"]: np.frombuffer(r["body"], np.int64) for r in done.collect()}


def block_rows(counts: np.ndarray, size: int) -> pa.RecordBatch:
    """The blocks of an int32 vector that hold anything."""
    blocks = counts.reshape(-1, size)
    some = np.flatnonzero(blocks.any(axis=1))
    return pa.record_batch([pa.array(some, pa.int64()), pa.array([blocks[b].astype(np.int32).tobytes() for b in some], pa.binary())], names=["block", "body"])


def with_score(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], name: str) -> DataFrame:
    """``docs`` with a double column ``name`` in [0, 1] from its text column, in place of any column of that name."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept)).toDF(*plain_names(kept))
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(scorer(column(batch, "text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(released(run), schema).toDF(*kept, name)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
