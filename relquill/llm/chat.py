"""Operator 1, chat formatting by columnar byte assembly.

Template, per turn: ``### `` role ``:\\n`` text ``</turn>\\n``. Inside texts every
``\\``, ``#`` and ``<`` is preceded by a backslash, inside roles also ``:`` and the
newline, so no control string can arise from content and the escape reverses
exactly. Loss spans are the escaped assistant texts.

Conversations are streamed in (conversation, turn) order: one sort, then batches;
a conversation of any length passes through in pieces ("parts"), so no group is
gathered in memory. Its digests are sequential by definition and kept as running
states. Batches are assembled in slices of about ``SLICE`` bytes; assembling takes some 30
bytes of memory a byte of a slice, and a very long text is a slice of its own (escaped it must
stay below 2 GiB, which is all that a string holds). Null text and null role: empty. Null
conv_id: a conversation of its own. Repeated rows stay, ties on turn are ordered by role
and text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import arrow_text, batch_of, column, document_slices, scatter_index, text_bytes

HEAD, MID, TAIL, SLASH = b"### ", b":\n", b"</turn>\n", 92
TRAINED_ROLE = b"assistant"
SLICE = 1 << 22

FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("turns", pa.int64()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
FORMATTED_DDL = "conv_id long, part long, formatted string, turns long, loss_starts array<long>, loss_ends array<long>"
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _class(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_TEXT_ESCAPES, _ROLE_ESCAPES = _class(b"\\#<"), _class(b"\\#<:\n")


def escaped(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column with a backslash before each marked byte: new bytes and offsets."""
    hit = marks[data]
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(hit, out=shift[1:])
    out = np.full(len(data) + int(shift[-1]), SLASH, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def escaping(data: np.ndarray) -> np.ndarray:
    """Which bytes of well-formed escaped text are escaping backslashes: every other one of a run."""
    slash = data == SLASH
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at
    return slash & ((at - last_other) % 2 == 1)


def unescaped(data: np.ndarray) -> bytes:
    return data[~escaping(data)].tobytes()


def assemble(batch: pa.RecordBatch, parts: dict) -> pa.RecordBatch:
    """One part row for each conversation of a batch, cut from one preallocated buffer."""
    conv = column(batch, "conv_id").to_pylist()
    role, role_at = text_bytes(column(batch, "role"))
    text, text_at = text_bytes(column(batch, "text"))
    trained = [role[a:b].tobytes() == TRAINED_ROLE for a, b in zip(role_at[:-1], role_at[1:], strict=True)]
    role, role_at = escaped(role, role_at, _ROLE_ESCAPES)
    text, text_at = escaped(text, text_at, _TEXT_ESCAPES)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    fixed = len(HEAD) + len(MID) + len(TAIL)
    at = np.zeros(len(conv) + 1, np.int64)
    np.cumsum(n_role + n_text + fixed, out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)

    def put(where: np.ndarray, what: bytes) -> None:
        out[where[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)

    roles = at[:-1] + len(HEAD)
    texts = roles + n_role + len(MID)
    put(at[:-1], HEAD)
    out[scatter_index(roles, n_role)] = role
    put(roles + n_role, MID)
    out[scatter_index(texts, n_text)] = text
    put(texts + n_text, TAIL)

    # code point positions: bytes that do not continue a character
    chars = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
    cuts = [0] + [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]] + [len(conv)]
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        same = parts.get("conv", parts) == conv[a]
        parts["part"] = parts["part"] + 1 if same else 0
        parts["conv"] = conv[a]
        own = [i for i in range(a, b) if trained[i]]
        base = chars[at[a]]
        for r, v in zip(rows, (conv[a], parts["part"], b - a, [int(chars[texts[i]] - base) for i in own], [int(chars[texts[i] + n_text[i]] - base) for i in own]), strict=True):
            r.append(v)
    formatted = arrow_text(out, at[cuts])
    return batch_of(FORMATTED, rows[0], rows[1], formatted.cast(pa.string()), rows[2], rows[3], rows[4])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted parts: (conv_id, part, formatted, turns, loss_starts, loss_ends).

    A conversation's parts stand in order in one partition; spans are code points
    of ``formatted``. Most conversations have a single part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            sizes = text_bytes(column(batch, "role"))[1] + text_bytes(column(batch, "text"))[1]
            for a, b in document_slices(sizes, SLICE):
                yield assemble(batch.slice(a, b - a), parts)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED_DDL)


def parse_turns(data: np.ndarray) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of one formatted part, unescaped."""
    free = np.ones(len(data), bool)
    held = escaping(data)
    free[1:] = ~held[:-1]
    free &= ~held
    heads = np.flatnonzero(free & (data == HEAD[0]))
    heads = heads[:: len(HEAD) - 1]  # the three signs of each header
    colons, tails = np.flatnonzero(free & (data == MID[0])), np.flatnonzero(free & (data == TAIL[0]))
    out = []
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        c = int(colons[np.searchsorted(colons, h)])
        out.append((unescaped(data[h + len(HEAD) : c]), unescaped(data[c + len(MID) : t])))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def ended() -> pa.RecordBatch:
            conv, n, turns, loss_n, loss, chars = state
            return batch_of(DIGESTS, [conv], [n], [turns.hexdigest()], [loss_n], [loss.hexdigest()], [chars])

        for batch in batches:
            done = []
            spans = column(batch, "loss_starts").to_pylist(), column(batch, "loss_ends").to_pylist()
            for conv, part, text, starts, ends in zip(column(batch, "conv_id").to_pylist(), column(batch, "part").to_pylist(), column(batch, "formatted").to_pylist(), *spans, strict=True):
                if part == 0:
                    if state is not None:
                        done.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_turns(np.frombuffer(text.encode(), np.uint8)):
                    state[1] += 1
                    state[2].update(role + b"\n" + said + b"\n")
                for a, b in zip(starts, ends, strict=True):
                    plain = unescaped(np.frombuffer(text[a:b].encode(), np.uint8))
                    state[3] += len(plain.decode())
                    state[4].update(plain)
                state[5] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield ended()

    return formatted.mapInArrow(run, DIGESTS_DDL)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))
