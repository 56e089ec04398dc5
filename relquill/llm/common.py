"""Shared helpers: the cluster's shared folder, shard files, byte-level numpy."""

from __future__ import annotations

import ctypes
import hashlib
import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.sources.shared import shared_root

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Class of the word contract: a word is a run of bytes outside 09-0D and 20.
WHITE = " \t\n\x0b\x0c\r"


# --- the shared folder -------------------------------------------------------


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return posixpath.join(shared_root(spark), f"relquill-{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder and read again."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A value that over one row in this many has is hot; there are at most as many such values.
HOT = 1024


def join_hot(rows: DataFrame, table: DataFrame, on: tuple[str, ...], count: str) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` that has the same ``on``, nulls equal; others go.

    ``table`` is stored, has one row for each value of ``on`` and in ``count`` the number of rows of
    it. Rows of hot values stay where they are: at most ``HOT`` rows of ``table`` go to every
    executor. The others meet in a shuffle whose tasks no value can fill.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    named = table.select(*(F.col(c).alias(f"by_{c}") for c in on), *(c for c in table.columns if c not in on))
    same = [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in on]
    is_hot = F.col(count) * HOT >= total
    hot, cold = F.broadcast(named.filter(is_hot)), named.filter(~is_hot)
    rest = rows.join(hot, same, "left_anti").join(cold, same)
    return rows.join(hot, same).unionByName(rest).drop(*(f"by_{c}" for c in on))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a URI (file, hdfs, s3, gs), as ``run_dir`` gives them."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores after it as no column of that name (any case) takes."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def plain_names(columns: list[str]) -> list[str]:
    """Names for a pass through Arrow, whatever the columns are called; ``text`` keeps its own."""
    return [c if c == "text" else f"column_{i}" for i, c in enumerate(columns)]


class ShardFile:
    """A file that appears under its name only when whole; retries replace it."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = posixpath.join(base, name)
        self.temp = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.final


def partition_id() -> int:
    return TaskContext.get().partitionId()


def spread(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side list of shards, one row to a partition."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, len(rows)), F.col(df.columns[0])) if len(rows) > 1 else df.coalesce(1)


# --- Arrow and bytes ---------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def long_list(column: pa.Array) -> list[int | None]:
    return column.to_pylist()


def document_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that together hold about ``limit`` bytes (one row may hold more)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


#: Entries of the table of powers that a worker keeps; texts beyond it have one of their own.
KEPT_POWERS = 1 << 21
_kept: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, up to n."""

    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    table = _kept
    if n >= len(table[0]):
        size = (n >> 16) + 1 << 16
        table = [run(_BASE), run(pow(_BASE, -1, 1 << 64))]
        if size <= KEPT_POWERS:
            _kept[:] = table
    return table[0][: n + 1], table[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = the polynomial of bytes i..j times base**i, modulo 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place: every input bit reaches every output bit."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def gram_values(prefix: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of all k-byte strings, from their prefix hash: equal for equal strings, unmixed."""
    n = len(prefix) - 1
    if n < k:
        return np.zeros(0, np.uint64)
    _, down = powers(n)
    return (prefix[k:] - prefix[:-k]) * down[: n - k + 1]


def span_values(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the strings [start, end), unmixed."""
    _, down = powers(len(prefix) - 1)
    return (prefix[ends] - prefix[starts]) * down[starts]


def gram_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-byte strings."""
    return mix(gram_values(prefix, k))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the strings [start, end)."""
    return mix(span_values(prefix, starts, ends))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the contract's words; no word crosses a document."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start = inside & ~before
    start[edge] = inside[edge]
    end = before & ~inside
    end[edge] |= before[edge]
    return np.flatnonzero(start[:n]), np.flatnonzero(end)


def scatter_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start + length as one index array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n) - n
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def arrow_text(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over the given bytes, without a copy."""
    if offsets[-1] > 0x7FFFFFFF:
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sha256(data) -> str:
    return hashlib.sha256(data).hexdigest()


def released(run: Mapper) -> Mapper:
    """``run``, after which the worker gives memory that is free back to the system: workers idle between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

