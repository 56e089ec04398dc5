"""Operator 4, media columns: stored audio and its features.

Each text's UTF-8 bytes, filled with 255 to a positive multiple of 576, become the
samples of a mono 8-bit PCM WAV (12 kHz), stored as a binary column in the shared
folder. Features come from the bytes read back: polyphase resampling to 8 kHz,
Hann frames of 256 with half overlap, log-mel energies, hysteresis segmentation of
frame energy into time spans, and the log-mel picture pooled into a fixed shape
(``SHAPE``: time bins, bands). Digests, spans and the picture are stored as Arrow shards,
the picture as a fixed-shape tensor column, and the query reads them from there.

Clips are analysed ``FRAMES`` frames at a time, each piece resampled from the samples
that its frames and the filter reach, so pieces give the frames of the whole clip and memory
is bounded by a piece beside the clip and its levels. Null text: empty, 576 filling
samples. Very long texts: one clip. Equal texts give equal values. Repeated rows, ties and
null ids stay. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import ShardFile, column, document_slices, documents, filesystem, materialize, partition_id, run_dir, spread, text_bytes

UNIT, FILL, RATE, RATE_OUT = 576, 255, 12_000, 8_000
UP, DOWN, SIDE = 2, 3, 10
FRAME, HOP, BANDS, BINS = 256, 128, 24, 8
SHAPE = (BINS, BANDS)
#: Frames analysed at once; bytes of texts made into clips at once.
FRAMES, SLICE = 4096, 1 << 22
#: Hysteresis: a span opens this much above the clip's mean level and closes this much below it (dB).
OPEN_DB, CLOSE_DB = 1.0, -1.0

TENSOR = pa.fixed_shape_tensor(pa.float32(), SHAPE, dim_names=("time", "band"))
FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("frames", pa.int64()), ("span_starts", pa.list_(pa.float64())), ("span_ends", pa.list_(pa.float64())), ("tensor", TENSOR),
])
PLAIN_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long"


def wav(payload: bytes) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: memoryview | bytes) -> np.ndarray:
    """The 8-bit samples of a WAV, found by walking its chunks."""
    raw = memoryview(media)
    if bytes(raw[:4]) != b"RIFF" or bytes(raw[8:12]) != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(raw):
        size = struct.unpack_from("<I", raw, at + 4)[0]
        if bytes(raw[at : at + 4]) == b"data":
            return np.frombuffer(raw, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    raise ValueError("a WAV without samples")


@functools.cache
def _phases() -> tuple[np.ndarray, int]:
    """The low-pass filter cut into UP phases, each reversed for a sliding product."""
    reach = SIDE * max(UP, DOWN)
    t = np.arange(-reach, reach + 1)
    taps = np.sinc(t / max(UP, DOWN)) * np.kaiser(len(t), 5.0)
    taps *= UP / taps.sum()
    per = -(-len(taps) // UP)
    return np.stack([np.pad(taps[p::UP], (0, per - len(taps[p::UP])))[::-1] for p in range(UP)]).astype(np.float32), reach


def out_length(samples_: int) -> int:
    return -(-samples_ * UP // DOWN)


def resample(payload: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Polyphase resampling by UP / DOWN of 8-bit samples, silent before and after the clip; output k
    is the input at time k * DOWN / UP. Outputs lo to hi, from the samples that they reach."""
    phases, reach = _phases()
    per = phases.shape[1]
    hi = out_length(len(payload)) if hi is None else hi
    # output k reads the inputs before last(k), per of them
    last = lambda k: (k * DOWN + reach) // UP + 1
    begin, end = last(lo) - per, last(hi - 1)
    x = np.zeros(end - begin, np.float32)
    a, b = max(begin, 0), min(end, len(payload))
    x[a - begin : b - begin] = (payload[a:b].astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.sliding_window_view(x, per)
    out = np.empty(hi - lo, np.float32)
    for k in range(lo, min(lo + UP, hi)):
        own = out[k - lo :: UP]
        own[:] = view[last(k) - per - begin :: DOWN][: len(own)] @ phases[(k * DOWN + reach) % UP]
    return out


@functools.cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    top = 2595 * np.log10(1 + RATE_OUT / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE_OUT)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel energies in dB, and each frame's level in dB."""
    window, bank = _mel()
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    level = 10 * np.log10((frames**2).mean(axis=1) + 1e-10)
    return (10 * np.log10(power.astype(np.float32) @ bank + 1e-8)).astype(np.float32), level


def spans(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last frames of the hysteresis segments."""
    mean = level.mean()
    event = np.where(level >= mean + OPEN_DB, 1, np.where(level < mean + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[last] > 0, False)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def analyse(payload: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Frames, span starts and ends in seconds, and the pooled (BINS, BANDS) tensor."""
    n = max(1, (out_length(len(payload)) - FRAME) // HOP + 1)
    lo = np.arange(BINS) * n // BINS
    hi = np.maximum(lo + 1, (np.arange(BINS) + 1) * n // BINS)
    level, pooled = np.empty(n), np.zeros((BINS, BANDS))
    for f in range(0, n, FRAMES):
        end = min(n, f + FRAMES)
        picture, level[f:end] = log_mel(resample(payload, f * HOP, min(out_length(len(payload)), (end - 1) * HOP + FRAME)))
        total = np.zeros((end - f + 1, BANDS))
        np.cumsum(picture, axis=0, out=total[1:])
        pooled += total[np.clip(hi - f, 0, end - f)] - total[np.clip(lo - f, 0, end - f)]
    a, b = spans(level)
    return n, a * HOP / RATE_OUT, b * HOP / RATE_OUT, (pooled / (hi - lo)[:, None]).astype(np.float32)


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            doc = column(batch, "doc_id")
            for a, b in document_slices(offsets, SLICE):
                media = []
                for i, j in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True):
                    fill = -(j - i) % UNIT or (0 if j > i else UNIT)
                    media.append(wav(data[i:j].tobytes() + bytes([FILL]) * fill))
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "audio")


def write_features(stored: DataFrame, folder: str) -> list:
    """Arrow shards of ``FEATURES`` below ``folder``, the picture as a fixed-shape tensor; one row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, out, n = f"features-{partition_id():07d}.arrow", None, None, 0
        for batch in batches:
            docs, sizes = column(batch, "doc_id").to_pylist(), column(batch, "n_bytes").to_pylist()
            clips = column(batch, "media")
            for at in range(0, batch.num_rows, 512):
                rows = []
                for i in range(at, min(at + 512, batch.num_rows)):
                    media = clips[i].as_buffer()
                    payload = samples(media)
                    frames, a, b, tensor = analyse(payload)
                    raw = payload.data
                    rows.append((docs[i], sizes[i], len(payload), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), media.size, hashlib.sha256(media).hexdigest(), frames, a, b, tensor.ravel()))
                *plain, tensors = zip(*rows, strict=True)
                picture = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors)), BINS * BANDS))
                if writer is None:
                    out = ShardFile(folder, name)
                    writer = pa.ipc.new_stream(out.out, FEATURES, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(plain, FEATURES, strict=False)), picture], schema=FEATURES))
                n += len(rows)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([partition_id()], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], names=["shard", "name", "rows"])

    return sorted(stored.mapInArrow(run, "shard long, name string, rows long").collect())  # one row a shard


def described(batch: pa.RecordBatch) -> pa.Array:
    """One line of figures a clip: frames, spans, their length, mean level by time bin and by band (dB)."""
    tensor = column(batch, "tensor").storage.flatten().to_numpy().reshape(-1, *SHAPE)
    seconds = [np.subtract(b, a).sum() for a, b in zip(column(batch, "span_starts").to_pylist(), column(batch, "span_ends").to_pylist(), strict=True)]
    counts = column(batch, "span_starts").value_lengths().to_pylist()
    listed = lambda x: ",".join(map(str, np.rint(x).astype(int).tolist()))
    return pa.array([f"frames={f};spans={n};active_ms={round(s * 1000)};bins={listed(t.mean(axis=1))};bands={listed(t.mean(axis=0))}" for f, n, s, t in zip(column(batch, "frames").to_pylist(), counts, seconds, tensor, strict=True)])


def read_features(spark: SparkSession, folder: str, manifest: list, described_too: bool = False) -> DataFrame:
    """The stored rows, the tensor as array<float> in row order; ``described_too``: with a column feature instead of spans and tensor."""
    ddl = PLAIN_DDL + (", feature string" if described_too else ", span_starts array<double>, span_ends array<double>, tensor array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in column(batch, "name").to_pylist():
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream, pa.ipc.open_stream(stream) as reader:
                    for own in reader:
                        plain = own.columns[: PLAIN_DDL.count(",") + 1]
                        if described_too:
                            yield pa.RecordBatch.from_arrays([*plain, described(own)], names=[*own.schema.names[: len(plain)], "feature"])
                        else:
                            flat = own.columns[-1].storage
                            tensor = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * BINS * BANDS, pa.int32()), flat.flatten())
                            yield pa.RecordBatch.from_arrays([*own.columns[:-1], tensor], names=own.schema.names)

    return spread(spark, [(r["shard"], r["name"]) for r in manifest], "shard long, name string").mapInArrow(run, ddl)


def audio_features(docs: DataFrame, described_too: bool = False) -> DataFrame:
    """Store the clips of ``docs`` (doc_id, text) and their features, and read the features back."""
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "features")
    return read_features(spark, folder, write_features(store_audio(docs), folder), described_too)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(documents(spark, sf_dir), described_too=True).drop("frames")
