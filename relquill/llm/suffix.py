"""Operator 9, exact substring removal with a logarithmic family of suffix arrays.

A byte goes if a ``WINDOW``-byte string that covers it starts anywhere else too.

1. Every window is routed by content: its leftmost smallest ``GRAM``-byte hash (its
   anchor) is the same wherever the window stands. Consecutive windows with one
   anchor form a context, about 80 windows, stored as digests beside their place.
   Texts are written once to the shared folder and never shuffled.
2. Contexts are sorted by (anchor, digest). Lone anchors hold no repeat and end here. Of each
   other anchor one row a distinct context goes on, its entry, with whether it occurs again.
3. The bytes of the entries are fetched from the stored texts and indexed: a logarithmic family
   of suffix arrays over the anchors' places, sparse because a window that occurs
   twice has its anchor at the same place in both. Each batch of contexts gets the suffix array
   of its anchors, is merge-scanned against the levels before it, and levels of equal size merge
   geometrically. Where suffixes share their gram, their common bytes to the right and to the left
   are counted, and those of 200 or more together mark the windows that both contexts
   hold. A context that occurs again stands in the array twice.
4. The index's marks decide for all rows: copies of a context take those of its entry.
   Anchors with more than ``CROWD`` contexts are dealt once more, by a 128-bit digest of each
   whole window, so no task gathers them.
5. Marked windows return to their texts, whose covered bytes are cut out.

Windows never cross documents. Null text: empty. Texts under ``WINDOW`` bytes keep all. Very
long texts are cut into contexts by slices that share their border's windows. Repeated rows are
places of their own, so they remove each other; ties cannot arise. Null or repeated
doc_id: harmless, rows are told apart by their place. Extra columns are ignored. ``docs`` must be
a stable table: a repeated attempt writes the same shard. Empty table: no rows. Equal (anchor,
context digest) pairs, 128 bits, count as one context; bytes are compared between entries.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import ShardFile, batch_of, column, document_slices, documents, filesystem, gram_hashes, materialize, mix, partition_id, prefix_hash, run_dir, scatter_index, span_hashes, text_bytes

WINDOW, GRAM = 200, 32
SPAN = WINDOW - GRAM + 1
SLICE = 1 << 20
#: Distinct contexts of an anchor that one index takes; more are dealt by window.
CROWD = 4096
#: Contexts of one batch of an index, contexts at which a family is closed (where the anchor changes), pairs compared at once.
BATCH, FAMILY, COMPARED = 2048, 1 << 15, 1 << 15

#: A place: where a context begins, where its anchor stands in it, and its windows.
_PLACE_BITS, _SHARD_BITS, _COUNT_BITS, _OFFSET_BITS = 23, 32, 9, 8
#: ``sure``: the same context stands twice in the rows beside it, so it is a repeat wherever it goes.
CONTEXTS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("text", pa.int64()), ("place", pa.int64()), ("sure", pa.bool_())])
CONTEXTS_DDL = "anchor long, digest long, text long, place long, sure boolean"


# --- contexts -----------------------------------------------------------------


def sliding(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values, by block prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, digest, anchor's place in it) of each context of some documents."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = prefix_hash(data)
    grams = gram_hashes(prefix, GRAM)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    keyed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding(keyed, SPAN) & mask).astype(np.int64)
    at = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = at + WINDOW <= offsets[1:][doc]
    at, anchor, doc = at[valid], anchor[valid], doc[valid]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0)]))
    count = np.diff(np.append(first, len(at)))
    start, anchor, doc = at[first], anchor[first], doc[first]
    body = span_hashes(prefix, start, start + count + WINDOW - 1)
    # where the anchor stands and how many windows there are belong to the context
    digest = mix(body ^ (count.astype(np.uint64) << np.uint64(20)) ^ (anchor - start).astype(np.uint64))
    return doc, start, count, grams[anchor], digest, anchor - start


def text_contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts of a whole column; texts above a slice are cut, with WINDOW - 1 bytes shared."""
    for a, b in document_slices(offsets, SLICE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b == a + 1 and hi - lo > SLICE:
            for s in range(lo, hi, SLICE):
                piece = data[s : min(hi, s + SLICE + WINDOW - 1)]
                doc, start, *rest = contexts(piece, np.array([0, len(piece)]))
                yield (doc + a, start + (s - lo), *rest)
        else:
            own = offsets[a : b + 1] - lo
            doc, start, *rest = contexts(data[lo:hi], own)
            yield (doc + a, start - own[doc], *rest)


def third_and_later(digest: np.ndarray) -> np.ndarray:
    """Which contexts come after two equal ones."""
    order = np.argsort(digest, kind="stable")
    ranked = digest[order]
    out = np.zeros(len(digest), bool)
    out[order[2:]] = ranked[2:] == ranked[:-2]
    return out


def shard_name(shard: int) -> str:
    return f"texts-{shard:07d}.arrow"


def store_and_deal(docs: DataFrame, folder: str) -> DataFrame:
    """Write (doc_id, text) shards below ``folder`` and return the contexts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, writer, row = partition_id(), None, None, 0
        for batch in batches:
            if writer is None:
                out = ShardFile(folder, shard_name(shard))
                writer = pa.ipc.new_stream(out.out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            for at in range(0, batch.num_rows, 2048):
                writer.write_batch(batch.slice(at, 2048))
            for doc, start, count, anchor, digest, offset in text_contexts(*text_bytes(column(batch, "text"))):
                if len(doc):
                    yield batch_of(CONTEXTS, anchor.view(np.int64), digest.view(np.int64), (shard << _SHARD_BITS) + row + doc, (((start << _OFFSET_BITS) + offset) << _COUNT_BITS) + count, third_and_later(digest))
            row += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CONTEXTS_DDL)


# --- repeats among sorted rows -------------------------------------------------

REPEATS_DDL = "anchor long, digest long, text long, place long, often boolean, entry boolean"
REPEATS = pa.schema([*list(CONTEXTS)[:4], ("often", pa.bool_()), ("entry", pa.bool_())])


def repeated(rows: DataFrame) -> DataFrame:
    """Rows whose anchor occurs more than once. ``often``: so does the context. ``entry``:
    the one row that stands for its context.

    Rows are sorted by (anchor, digest) and streamed; each row is judged by its
    neighbours, so a group of any size passes through without being gathered. Sure rows
    are repeats already and need no neighbours: they are dealt by their place, so that a
    context that stands everywhere reaches its anchor's task at most twice a slice.
    """
    names = ("anchor", "digest", "text", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(a, d, t, p, before: tuple | None, after: tuple | None) -> pa.RecordBatch | None:
            """Judge rows between the one before and the one after."""
            same_a = np.concatenate([[before is not None and before[0] == a[0]], a[1:] == a[:-1], [after is not None and after[0] == a[-1]]])
            same_d = same_a & np.concatenate([[before is not None and before[1] == d[0]], d[1:] == d[:-1], [after is not None and after[1] == d[-1]]])
            keep = same_a[:-1] | same_a[1:]
            often, entry = (same_d[:-1] | same_d[1:])[keep], ~same_d[:-1][keep]
            return batch_of(REPEATS, a[keep], d[keep], t[keep], p[keep], often, entry) if keep.any() else None

        held, before = None, None
        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in names]
            sure = column(batch, "sure").to_numpy(zero_copy_only=False)
            if sure.any():
                yield batch_of(REPEATS, *(c[sure] for c in cols), np.ones(int(sure.sum()), bool), np.zeros(int(sure.sum()), bool))
                cols = [c[~sure] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                out = judged(*(c[:-1] for c in cols), before, (int(held[0][0]), int(held[1][0])))
                before = (int(cols[0][-2]), int(cols[1][-2]))
                if out is not None:
                    yield out
        if held is not None:
            out = judged(*held, before, None)
            if out is not None:
                yield out

    dealt = rows.select("anchor", "digest", "text", "place", "sure", F.when(F.col("sure"), F.xxhash64("text", "place")).otherwise(F.col("anchor")).alias("deal"))
    return dealt.repartition(F.col("deal")).sortWithinPartitions("anchor", "digest", "text", "place").drop("deal").mapInArrow(run, REPEATS_DDL)


# --- the index -----------------------------------------------------------------


class Level:
    """A suffix array: numbers of contexts in the order of their bytes from the anchor on."""

    def __init__(self, order: np.ndarray, suffixes: np.ndarray):
        self.order, self.suffixes = order, suffixes
        self.grams = np.ascontiguousarray(suffixes.view(np.uint8).reshape(len(order), -1)[:, :GRAM]).view(f"S{GRAM}").ravel()


class IndexFamily:
    """Suffix arrays of geometrically growing batches over the anchors of contexts; marks windows that occur twice.

    A context is a row of ``WIDTH`` bytes with its anchor at ``LEFT``, filled with zeros that
    its extents keep out of any comparison.
    """

    LEFT, WIDTH = SPAN - 1, SPAN - 1 + WINDOW

    def __init__(self):
        self.levels: list[Level | None] = []
        self.size = 0
        self.rows = np.zeros((0, self.WIDTH), np.uint8)
        self.left, self.right, self.count = (np.zeros(0, np.int64) for _ in range(3))
        #: changes, along the bytes that a window has before its anchor, of how often it was met
        self.met = np.zeros((0, SPAN + 1), np.int32)

    def grow(self, n: int) -> None:
        """Room for n contexts more."""
        if (need := self.size + n) > len(self.rows):
            room = max(need, 2 * len(self.rows))
            for name in ("rows", "left", "right", "count", "met"):
                old = getattr(self, name)
                new = np.zeros((room, *old.shape[1:]), old.dtype)
                new[: self.size] = old[: self.size]
                setattr(self, name, new)

    def add(self, data: np.ndarray, ends: np.ndarray, left: np.ndarray, again: np.ndarray) -> None:
        """Contexts as concatenated bytes and their n + 1 borders, the bytes before each anchor, and which occur again."""
        n, base, size = len(left), self.size, np.diff(ends)
        self.grow(n)
        own = slice(base, base + n)
        flat = self.rows[own].reshape(-1)
        flat[scatter_index(np.arange(n) * self.WIDTH + self.LEFT - left, size)] = data[ends[0] : ends[-1]]
        self.left[own], self.right[own], self.count[own] = left, size - left, size - WINDOW + 1
        self.met[own.start : own.stop, 0] += again
        self.size += n
        # fixed width bytes compare as memcmp
        suffixes = np.ascontiguousarray(self.rows[own, self.LEFT :]).view(f"S{WINDOW}").ravel()
        order = np.argsort(suffixes, kind="stable")
        new = Level(order + base, suffixes[order])
        # runs of one gram within the batch: each suffix with those after it
        edge = np.flatnonzero(np.concatenate([[True], new.grams[1:] != new.grams[:-1], [True]]))
        after = np.repeat(edge[1:], np.diff(edge)) - np.arange(n) - 1
        self.compare(new.order, after, new.order, np.arange(n) + 1)
        for level in self.levels:
            if level is not None:
                low = np.searchsorted(level.grams, new.grams, side="left")
                self.compare(new.order, np.searchsorted(level.grams, new.grams, side="right") - low, level.order, low)
        rank = 0
        while rank < len(self.levels) and self.levels[rank] is not None:
            new = self.merged(self.levels[rank], new)
            self.levels[rank] = None
            rank += 1
        if rank == len(self.levels):
            self.levels.append(None)
        self.levels[rank] = new

    def compare(self, one: np.ndarray, times: np.ndarray, others: np.ndarray, low: np.ndarray) -> None:
        """Each of ``one`` with as many of ``others`` from ``low`` on: they share their gram."""
        some = np.flatnonzero(times > 0)
        for a, b in document_slices(np.concatenate([[0], np.cumsum(times[some])]), COMPARED):
            own, n = some[a:b], times[some[a:b]]
            i, j = np.repeat(one[own], n), others[scatter_index(low[own], n)]
            most = np.minimum(self.right[i], self.right[j])
            r = np.minimum(self.common(self.rows[i, self.LEFT :] == self.rows[j, self.LEFT :]), most)
            reach = np.minimum(self.left[i], self.left[j])
            near = np.flatnonzero(reach + r >= WINDOW)
            i, j, r, reach = i[near], j[near], r[near], reach[near]
            left = np.minimum(self.common((self.rows[i, : self.LEFT] == self.rows[j, : self.LEFT])[:, ::-1]), reach)
            both = np.flatnonzero(left + r >= WINDOW)
            # windows with WINDOW - r to ``left`` bytes before the anchor
            first, last = np.maximum(WINDOW - r[both], 0), left[both] + 1
            for k in (i[both], j[both]):
                np.add.at(self.met, (k, first), 1)
                np.add.at(self.met, (k, last), -1)

    @staticmethod
    def common(same: np.ndarray) -> np.ndarray:
        """How many columns of each row are true before the first that is not."""
        return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1)) if len(same) else np.zeros(0, np.int64)

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        place = np.searchsorted(a.suffixes, b.suffixes, side="right") + np.arange(len(b.suffixes))
        rest = np.ones(len(a.suffixes) + len(b.suffixes), bool)
        rest[place] = False
        suffixes, order = np.empty(len(rest), a.suffixes.dtype), np.empty(len(rest), np.int64)
        suffixes[place], order[place] = b.suffixes, b.order
        suffixes[rest], order[rest] = a.suffixes, a.order
        return Level(order, suffixes)

    def marked(self) -> list[np.ndarray]:
        """Of each context, which of its windows occur twice, in their order."""
        found = np.cumsum(self.met[: self.size, :SPAN], axis=1) > 0
        return [row[p - c + 1 : p + 1][::-1] for row, p, c in zip(found, self.left[: self.size].tolist(), self.count[: self.size].tolist(), strict=True)]


MARKS = pa.schema([("text", pa.int64()), ("place", pa.int64()), ("marks", pa.binary())])
MARKS_DDL = "text long, place long, marks binary"
BODIES = pa.schema([*list(CONTEXTS)[:4], ("often", pa.bool_()), ("body", pa.binary())])
BODIES_DDL = "anchor long, digest long, text long, place long, often boolean, body binary"
INDEXED = pa.schema([*list(BODIES)[:5], ("marks", pa.binary())])
INDEXED_DDL = "anchor long, digest long, text long, place long, often boolean, marks binary"


def indexed(bodies: DataFrame) -> DataFrame:
    """(anchor, digest, text, place, often, marks) of the contexts with windows that occur twice, by families of whole anchors."""
    names = [f.name for f in INDEXED][:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, last = IndexFamily(), [], None

        def ended() -> Iterator[pa.RecordBatch]:
            # no bits where every window is marked
            marks = [(b"" if x.all() else np.packbits(x).tobytes()) if x.any() else None for x in family.marked()]
            whole = pa.Table.from_batches(rows).append_column("marks", pa.array(marks, pa.binary()))
            yield from whole.filter(pc.is_valid(whole["marks"])).combine_chunks().to_batches()

        for batch in batches:
            anchor, place = column(batch, "anchor").to_numpy(), column(batch, "place").to_numpy()
            often = column(batch, "often").to_numpy(zero_copy_only=False)
            data, ends = text_bytes(column(batch, "body"))
            a = 0
            while a < batch.num_rows:
                b = min(a + BATCH, batch.num_rows)
                if family.size >= FAMILY:
                    # only the rest of the last anchor is still the family's
                    b = min(b, a + int(np.argmax(np.append(anchor[a:b] != last, True))))
                    if a == b:
                        yield from ended()
                        family, rows = IndexFamily(), []
                        continue
                family.add(data, ends[a : b + 1], place[a:b] >> _COUNT_BITS & ((1 << _OFFSET_BITS) - 1), often[a:b])
                rows.append(batch.select(names).slice(a, b - a))
                a, last = b, anchor[b - 1]
        if rows:
            yield from ended()

    return bodies.repartition(F.col("anchor")).sortWithinPartitions("anchor", "digest").mapInArrow(run, INDEXED_DDL)


# --- between places and texts ---------------------------------------------------


def by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.shiftright("text", _SHARD_BITS)).sortWithinPartitions("text", "place")


def stored_texts(folder: str, shard: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, batch) of a shard."""
    fs, base = filesystem(folder)
    row = 0
    with fs.open_input_stream(posixpath.join(base, shard_name(shard)), compression=None) as stream, pa.ipc.open_stream(stream) as reader:
        for batch in reader:
            yield row, batch
            row += batch.num_rows


def shards_in(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list]]:
    """(shard, its rows as a column each) from rows in order of their text."""
    shard, held = None, []
    for batch in batches:
        number = column(batch, "text").to_numpy() >> _SHARD_BITS
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if shard is not None and number[a] != shard:
                yield shard, [pa.concat_arrays([h[i] for h in held]) for i in range(len(names))]
                held = []
            shard = int(number[a])
            held.append([column(batch, n).slice(a, b - a) for n in names])
    if shard is not None:
        yield shard, [pa.concat_arrays([h[i] for h in held]) for i in range(len(names))]


def split_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where contexts begin, and their windows."""
    return place >> _COUNT_BITS + _OFFSET_BITS, place & ((1 << _COUNT_BITS) - 1)


def wanted(folder: str, shard: int, text: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row of ``text``, bytes of its context), the shard read once, in order."""
    row = text & ((1 << _SHARD_BITS) - 1)
    start, count = split_place(place)
    for base, batch in stored_texts(folder, shard):
        a, b = np.searchsorted(row, [base, base + batch.num_rows])
        if a == b:
            continue
        data, offsets = text_bytes(column(batch, "text"))
        lo = offsets[row[a:b] - base] + start[a:b]
        for i, s, n in zip(range(a, b), lo.tolist(), count[a:b].tolist(), strict=True):
            yield i, data[s : s + n + WINDOW - 1]


def fetched(entries: DataFrame, folder: str) -> DataFrame:
    """Entries with the bytes of their contexts."""
    names = tuple(f.name for f in BODIES)[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, cols in shards_in(batches, names):
            text, place = cols[2].to_numpy(), cols[3].to_numpy()
            at, bodies = [], []
            for i, body in wanted(folder, shard, text, place):
                at.append(i)
                bodies.append(body.tobytes())
                if len(at) == 8192:
                    yield batch_of(BODIES, *(c.take(pa.array(at)) for c in cols), bodies)
                    at, bodies = [], []
            if at:
                yield batch_of(BODIES, *(c.take(pa.array(at)) for c in cols), bodies)

    return by_shard(entries.select(*names)).mapInArrow(run, BODIES_DDL)


def crowded(entries: DataFrame, folder: str) -> DataFrame:
    """Marked windows of crowded anchors: one row a window, by the digest of its bytes."""
    names = ("anchor", "text", "place", "often")
    schema = pa.schema([*list(CONTEXTS)[:4], ("window", pa.int64()), ("often", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, cols in shards_in(batches, names):
            text, place, often = cols[1].to_numpy(), cols[2].to_numpy(), cols[3].to_numpy(zero_copy_only=False)
            for i, body in wanted(folder, shard, text, place):
                n = len(body) - WINDOW + 1
                digests = np.frombuffer(b"".join(hashlib.blake2b(body[k : k + WINDOW], digest_size=16).digest() for k in range(n)), np.int64).reshape(n, 2)
                yield batch_of(schema, digests[:, 0], digests[:, 1], np.full(n, text[i]), np.full(n, place[i]), np.arange(n), np.full(n, often[i]))

    rows = by_shard(entries.select(*names)).mapInArrow(run, "anchor long, digest long, text long, place long, window long, often boolean")
    # the place of a window rides in the low bits: its context's place, then its number
    packed = rows.select("anchor", "digest", "text", (F.shiftleft("place", _COUNT_BITS).bitwiseOR(F.shiftleft("window", 1)).bitwiseOR(F.col("often").cast("long"))).alias("place"), F.lit(False).alias("sure"))
    twice = repeated(packed).filter(F.col("often")).select("text", F.shiftright("place", _COUNT_BITS).alias("place"), F.shiftright(F.col("place").bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)), 1).alias("window"), F.col("place").bitwiseAND(F.lit(1)).alias("whole"))
    marks = twice.filter("whole = 0").groupBy("text", "place").agg(F.collect_set("window").alias("windows"))  # 169 at most

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows, n in zip(column(batch, "windows").to_pylist(), split_place(column(batch, "place").to_numpy())[1].tolist(), strict=True):
                own = np.zeros(n, bool)
                own[windows] = True
                out.append(np.packbits(own).tobytes())
            yield batch_of(MARKS, column(batch, "text"), column(batch, "place"), out)

    return marks.mapInArrow(bits, MARKS_DDL)


def marked_windows(contexts_: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """(text, place, marks): contexts with windows that occur elsewhere; no bits: all of them."""
    found = materialize(repeated(contexts_), "repeats")
    entries, copies = found.filter("entry"), found.filter("often").select("anchor", "digest", "text", "place")
    crowds = materialize(entries.groupBy("anchor").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > crowd), "crowds")
    more = None
    if crowds.limit(1).count():
        crowded_ = entries.join(crowds, "anchor", "left_semi")
        more = crowded(crowded_, folder).unionByName(copies.join(crowds, "anchor", "left_semi").select("text", "place", F.lit(b"").alias("marks")))
        entries = entries.join(crowds, "anchor", "left_anti")
    index = materialize(indexed(fetched(entries, folder)), "index")
    once = index.filter("not often").select("text", "place", "marks")
    again = copies.join(index.filter("often").select("anchor", "digest", "marks"), ["anchor", "digest"]).select("text", "place", "marks")
    marks = once.unionByName(again)
    return marks if more is None else marks.unionByName(more)


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("kept", pa.binary())])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"


def covered(size: int, place: np.ndarray, marks: list[bytes | None]) -> np.ndarray:
    """Which bytes of a text lie in a marked window."""
    edge = np.zeros(size + 1, np.int32)
    start, count = split_place(place)
    whole = np.array([not bits for bits in marks])
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, (start + count - 1 + WINDOW)[whole], -1)
    for s, n, bits in zip(start.tolist(), count.tolist(), marks, strict=True):
        if bits:
            at = s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
            edge[at] += 1
            edge[at + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut_texts(marks: DataFrame, folder: str, bytes_too: bool = True) -> DataFrame:
    """Each stored text without its marked bytes, one row each."""
    spark = marks.sparkSession
    fs, base = filesystem(folder)
    import pyarrow.fs as pafs

    names = sorted(posixpath.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".arrow"))
    # every shard is visited, with or without marks: one sentinel row each
    every = spark.createDataFrame([((int(n[6:13]) << _SHARD_BITS), -1) for n in names], "text long, place long").withColumn("marks", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (text, place, marks_) in shards_in(batches, ("text", "place", "marks")):
            text, place = text.to_numpy() & ((1 << _SHARD_BITS) - 1), place.to_numpy()
            real = np.flatnonzero(place >= 0)
            text, place, marks_ = text[real], place[real], marks_.take(pa.array(real))
            for row, batch in stored_texts(folder, shard):
                data, offsets = text_bytes(column(batch, "text"))
                docs = column(batch, "doc_id").to_pylist()
                cut = np.searchsorted(text, row + np.arange(batch.num_rows + 1))
                out = []
                for i, doc in enumerate(docs):
                    own = data[offsets[i] : offsets[i + 1]]
                    a, b = int(cut[i]), int(cut[i + 1])
                    if a == b:
                        out.append((doc, len(own), 0, [], [], own.tobytes()))
                        continue
                    gone = covered(len(own), place[a:b], marks_.slice(a, b - a).to_pylist())
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    out.append((doc, len(own), int(gone.sum()), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), own[~gone].tobytes()))
                if not bytes_too:
                    out = [(*r[:5], hashlib.sha256(r[5]).hexdigest().encode()) for r in out]
                yield batch_of(KEPT, *zip(*out, strict=True))

    return by_shard(marks.unionByName(every)).mapInArrow(run, KEPT_DDL)


def without_repeats(docs: DataFrame, bytes_too: bool = True, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, span_starts, span_ends, kept) for each row of ``docs``.

    ``bytes_too`` False: ``kept`` is the lowercase hex SHA-256 of the kept bytes.
    """
    folder = run_dir(docs.sparkSession, "texts")
    return cut_texts(marked_windows(store_and_deal(docs, folder), folder, crowd), folder, bytes_too)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(documents(spark, sf_dir), bytes_too=False)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"))
