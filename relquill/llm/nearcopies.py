"""Near copies as the corpus pipeline takes them: word similarity of at least ``SIMILAR``,
found by SimHash and tables of distances to pivots, and an exact search for what these leave.

Two texts are near copies where the Jaccard similarity of their sets of 5-word
shingles (A-Z lowered, words split at 09-0D and 20) is 0.8 or more. Operator 3's radius of
2 bits finds few of them, so this is its method at a wider radius:

1. Texts of equal words are one class. Each class has a SimHash of ``BITS`` bits: every distinct
   shingle votes on each, the majority sets it. At a similarity of 0.8 about 38 bits differ (deviation
   6; 48 for texts of four and five shingles), of unlike texts 128 (deviation 8).
2. Pivots are fixed fingerprints and their complements, ``TABLES`` x ``PER`` sets of 2 x ``PIVOTS``.
   The distance of a class to a pivot is that between fingerprints, each bit weighed by its
   votes. The nearest pivot of each set of a table is the class's key there.
   At a radius this wide the triangle inequality discards next to nothing, the nearest pivots do.
3. Classes of a key meet in units of at most about 2 ``UNIT``: a larger key is dealt into parts, and
   every two parts meet in a unit, so a key may hold any share of the classes and nothing is
   capped. Of those at most ``RADIUS`` bits away a class is paired with the nearest and the first.
4. Pairs are verified by the exact similarity of their shingle sets, and linked. Then classes that
   have been paired meet again: first each with the nearest of another component, then those with
   any of another component in their radius with all of these, by fingerprints of ``FINE`` bits
   that tell a similarity of 0.8 from one of 0.7. These pairs are verified like the others.
5. Fingerprints and pivots miss a similar pair now and then (27 of 120,000 simulated ones at exactly 0.8), so an
   exact search over all classes follows. Two sets at 0.8 share one of the first fifth, and one, of their shingles
   in any order of all shingles; frequent ones come last, so that few classes share one. Classes of other
   components that do are compared by the parity of their shingles in each of 64 to 4096 parts: where it differs, at
   least one shingle is in one set only, and of sets at 0.8 a ninth of both together is. This loses nothing, and
   what passes is verified like the other pairs.

A class without another in its radius names no pair, and one component no more pairs, so rows grow
with the classes, not with the square of a group. Components as in operator 3. Shingles
and classes are told apart by 64-bit digests.
Null text or no words: one class. Fewer than five words: the whole sequence is the
shingle. Repeated rows keep their rows. Very long texts: a row is one text, hashed whole, its votes
counted a part at a time. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relquill.llm.common import batch_of, column, document_slices, join_hot, materialize, mix, prefix_hash, released, scatter_index, span_hashes, text_bytes, word_spans
from relquill.llm.simhash import _LOWER, components

WORDS, SIMILAR, BITS, RADIUS = 5, (4, 5), 256, 72
TABLES, PER, PIVOTS, UNIT = 40, 2, 64, 1024
SLICE = 1 << 20
#: Bits for classes that have been paired, their radius, and that of sets of up to ``FEW`` shingles, where one shingle sways more.
FINE, FINE_RADIUS, FEW, FEW_RADIUS = 4096, 730, 16, 890
#: Words of the widest parity; classes above which a key is frequent, and frequent keys that every task has. Others are only slower.
WIDE, OFTEN, FREQUENT = 64, 64, 1 << 20
#: Row numbers (8 bytes each) up to which a join sends them to every executor.
BROADCAST_ROWS = 1_000_000
FINGERPRINT = [f"f{k}" for k in range(BITS // 64)]

_PLACE = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_VOTE = mix(np.arange(201, 201 + FINE // 64, dtype=np.uint64)) | np.uint64(1)
#: (BITS, pivots): 1 where a pivot has the bit, else -1.
_PIVOTS = np.unpackbits(mix(np.arange(1, TABLES * PER * PIVOTS * BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8)).reshape(-1, BITS).T.astype(np.float32) * 2 - 1


def word_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class digest of each document, its number of shingles, all shingle hashes in order)."""
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    words = span_hashes(prefix_hash(data), starts, ends)
    counts = np.diff(first)
    has = counts > 0
    classes = np.zeros(len(counts), np.uint64)
    if has.any():
        nth = np.arange(len(words)) - np.repeat(first[:-1], counts)
        placed = mix(words + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        classes[has] = mix(np.add.reduceat(placed, first[:-1][has]) + counts[has].astype(np.uint64))
    n = np.where(has, np.maximum(1, counts - WORDS + 1), 0)
    at = scatter_index(first[:-1], n)
    last = np.repeat(first[1:], n)
    out = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        inside = at + j < last
        out[inside] += words[at[inside] + j] * _PLACE[j]
    return classes, n, mix(out)


#: Shingles whose votes fit a byte, bytes of votes counted at once, and sets.
PART, COUNTED, SETS = 255, 1 << 23, 256


def votes(sets: list[np.ndarray], width: int = BITS) -> np.ndarray:
    """(sets, width): of the distinct shingles of each set, those with the bit less those without."""
    vote, parts = _VOTE[: width // 64], COUNTED // (PART * width)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    count = -(-sizes // PART)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(np.cumsum(sizes) - sizes, count) + PART * nth
    bounds = np.append(starts, len(flat))
    ones = np.zeros((len(starts), width), np.uint8)
    for k in range(0, len(starts), parts):
        own = flat[bounds[k] : bounds[min(k + parts, len(starts))]]
        words = mix((own[:, None] + vote) * vote)
        # eight counters of a byte each to a number
        bits = np.unpackbits(words.view(np.uint8)).view(np.uint64).reshape(len(own), width // 8)
        ones[k : k + parts] = np.add.reduceat(bits, starts[k : k + parts] - bounds[k], axis=0).view(np.uint8)
    out = np.zeros((len(sets), width), np.int32)
    if len(starts):
        out[sizes > 0] = np.add.reduceat(ones, (np.cumsum(count) - count)[sizes > 0], axis=0, dtype=np.int32)
    return 2 * out - sizes[:, None].astype(np.int32)


def simhash(voted: np.ndarray) -> np.ndarray:
    """(sets, words) of the bits that over half of the shingles set."""
    return np.packbits(voted > 0, axis=1).view(np.uint64)


def pivot_keys(voted: np.ndarray) -> np.ndarray:
    """(sets, TABLES) keys: the table and its nearest pivots, by distances weighed with the votes; ties: the first."""
    # whole numbers below 2**15, whose sums are exact
    width = np.frexp(np.abs(voted).max(axis=1, initial=0))[1]
    scaled = voted >> np.maximum(width - 15, 0)[:, None]
    out = np.zeros((len(voted), TABLES), np.int64)
    for k in range(0, len(voted), 512):
        # the larger, the nearer; the most negative is nearest to the complement
        near = (scaled[k : k + 512].astype(np.float32) @ _PIVOTS).reshape(-1, TABLES, PER, PIVOTS)
        which = np.abs(near).argmax(axis=3)
        side = np.take_along_axis(near, which[..., None], 3)[..., 0] > 0
        out[k : k + 512] = ((2 * which + side) * (2 * PIVOTS) ** np.arange(PER)).sum(axis=2)
    return out + np.arange(TABLES) * (2 * PIVOTS) ** PER


def split_sets(n: np.ndarray, shingles: np.ndarray) -> list[np.ndarray]:
    """Distinct shingles of each document, in order."""
    return [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])]


def signed_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, cls, f0.., keys) for each row of ``docs``, which has a text column."""
    kept = docs.select(*keep, "text")
    added = ["cls", *FINGERPRINT, "keys"]
    schema = kept.select(*keep, *(F.lit(0).cast("long").alias(c) for c in added[:-1]), F.array(F.lit(0).cast("long")).alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for a, b in document_slices(offsets, SLICE):
                classes, n, shingles = word_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                has = n > 0
                voted = votes(split_sets(n, shingles))
                ends = np.concatenate([[0], np.cumsum(np.where(has, TABLES, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(pivot_keys(voted[has]).ravel()))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(column(own, c) for c in keep), pa.array(classes.view(np.int64)), *map(pa.array, np.ascontiguousarray(simhash(voted).T).view(np.int64)), listed], names=[*keep, *added])

    return kept.mapInArrow(released(run), schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(cls, shingles, fine) of (cls, text): distinct shingle digests in order, fingerprint of ``FINE`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for a, b in document_slices(offsets, SLICE):
                _, n, shingles = word_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets, fine = split_sets(n, shingles), []
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                for k in range(0, len(sets), SETS):
                    fine.extend(x.tobytes() for x in simhash(votes(sets[k : k + SETS], FINE)))
                yield pa.RecordBatch.from_arrays([column(batch.slice(a, b - a), "cls"), listed, pa.array(fine, pa.binary())], names=["cls", "shingles", "fine"])

    return texts.select("cls", "text").mapInArrow(released(run), "cls long, shingles array<long>, fine binary")


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Pairs that a task of ``close_pairs`` holds before it passes them on.
HELD = 1 << 20
_UNIT = ("key", "m", "s")


def units(keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, cls, root, f0..) dealt into units (key, m, s): every two classes of a key meet in one of them."""
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > UNIT)
    large = materialize(large.select("key", F.ceil(F.col("n") / F.lit(UNIT)).cast("int").alias("parts")), "large")
    return in_parts(keyed.join(F.broadcast(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), "root", *FINGERPRINT)


def in_parts(keyed: DataFrame, *keep: str) -> DataFrame:
    """(key, m, s, cls, *keep): each row of ``keyed`` (key, cls, parts, *keep) in every unit of its part."""
    dealt = keyed.withColumn("deal", F.pmod(F.xxhash64("key", "cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("deal", "other").alias("m"), F.greatest("deal", "other").alias("s"), "cls", *keep)


def whole_units(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(end of the unit of each row, [key, m, s, *names]) of runs of rows that hold whole units."""
    held = None

    def ends(rows: list[np.ndarray]) -> np.ndarray:
        key, m, s = rows[:3]
        return np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (s[1:] != s[:-1])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [column(batch, c).to_numpy(zero_copy_only=False) for c in (*_UNIT, *names)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = ends(held)
        if len(cut):
            yield np.repeat(cut, np.diff(cut, prepend=0)), [x[: cut[-1]] for x in held]
            held = [x[cut[-1] :] for x in held]
    if held is not None:
        cut = np.append(ends(held), len(held[0]))
        yield np.repeat(cut, np.diff(cut, prepend=0)), held


def close_rows(end: np.ndarray, root: np.ndarray, prints: list[np.ndarray], radius) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, later row, bits apart) of rows of one unit and different roots within the radius (of the first, if there is one a row)."""
    prints, radius = [f.view(np.uint64) for f in prints], np.broadcast_to(radius, len(end))
    at, step = np.arange(len(end)), 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            return
        a = at[root[at] != root[at + step]]
        apart = np.zeros(len(a), np.int64)
        for f in prints:
            apart += np.bitwise_count(f[a] ^ f[a + step])
        close = apart <= radius[a]
        if close.any():
            yield a[close], a[close] + step, apart[close]


def some_pairs(end: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each class with the nearest and the first of its unit that have another root."""
    cls, root, *prints = rows[3:]
    nearest, distance, first = cls.copy(), np.full(len(cls), BITS + 1), cls.copy()
    for a, b, apart in close_rows(end, root, prints, RADIUS):
        for x, y in ((a, b), (b, a)):
            less = apart < distance[x]
            nearest[x[less]], distance[x[less]] = cls[y[less]], apart[less]
        first[b] = cls[a]
    for met in (nearest, first):
        found = met != cls
        yield cls[found], met[found]


def all_pairs(end: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each class with all of its unit that have another root, by the fine fingerprints; sets of too different sizes cannot be similar.
    A pair comes from the first table that has it under one key, not from each."""
    cls, root, size, fine, keys = rows[3:]
    table, keys = rows[0] // (2 * PIVOTS) ** PER, np.array(keys.tolist(), np.int64).reshape(len(cls), TABLES)
    prints = list(np.frombuffer(b"".join(fine.tolist()), np.int64).reshape(len(cls), -1).T.copy())
    above, below = SIMILAR
    for a, b, _ in close_rows(end, root, prints, np.where(size <= FEW, FEW_RADIUS, FINE_RADIUS)):
        alike = np.minimum(size[a], size[b]) * below >= np.maximum(size[a], size[b]) * above
        a, b = a[alike], b[alike]
        once = (keys[a] == keys[b]).argmax(axis=1) == table[a]
        yield cls[a[once]], cls[b[once]]


def in_units(dealt: DataFrame, run, schema: str) -> DataFrame:
    order = [c for c in ("size", "cls") if c in dealt.columns]
    return dealt.repartition(*map(F.col, _UNIT)).sortWithinPartitions(*_UNIT, *order).mapInArrow(released(run), schema)


def close_pairs(dealt: DataFrame, pairs) -> DataFrame:
    """(a, b), a > b: the distinct ``pairs`` of the classes of each unit of ``dealt``."""
    names = [c for c in dealt.columns if c not in _UNIT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for end, rows in whole_units(batches, names):
            for a, b in pairs(end, rows):
                out.append((np.maximum(a, b), np.minimum(a, b)))
                size += len(a)
                if size > HELD:
                    yield batch_of(PAIRS, *(np.concatenate(x) for x in zip(*out, strict=True)))
                    out, size = [], 0
        if out:
            yield batch_of(PAIRS, *(np.concatenate(x) for x in zip(*out, strict=True)))

    return in_units(dealt, run, "a long, b long").distinct()


def crowded(dealt: DataFrame) -> DataFrame:
    """(key, m, s, cls, root): the rows of ``dealt`` with another root in their radius."""
    names = ["cls", "root", *FINGERPRINT]
    schema = dealt.select(*_UNIT, "cls", "root").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for end, rows in whole_units(batches, names):
            meets = np.zeros(len(end), bool)
            for a, b, _ in close_rows(end, rows[4], rows[5:], RADIUS):
                meets[a] = meets[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[meets]) for x in rows[:5]], names=schema.names)

    return in_units(dealt, run, schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose shingle sets are similar."""
    left, right = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    above, below = SIMILAR
    similar = both * below >= (F.size("of_a") + F.size("of_b") - both) * above
    return materialize(pairs.distinct().join(left, "a").join(right, "b").filter(similar).select("a", "b"), "similar")


# --- the exact search ------------------------------------------------------------


def bands(n: int) -> list[int]:
    """Powers of two from which on sets similar to one of ``n`` have their sizes; two sets meet in the smaller's."""
    if not n:
        return []
    k = n.bit_length() - 1
    above, below = SIMILAR
    return [k, k - 1] if k and n * above < below << k else [k]


def first_keys(own: np.ndarray, band: int, often: np.ndarray) -> np.ndarray:
    """Keys of the shingles of a set of which any similar one has one among its own: by key, those in ``often`` (in order) last."""
    above, below = SIMILAR
    keys = np.sort(mix(own + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    if len(often):
        keys = keys[np.argsort(often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys, kind="stable")]
    return keys[: len(own) + (-len(own) * above) // below + 1]


def parity(own: np.ndarray, band: int) -> bytes:
    """A bit for each part of the digests' range: whether an odd number of the set's is in it."""
    # small sets have more parts a shingle: fewer pairs just below 0.8 pass
    width = 64 * min(WIDE, max(1, min(8 << band, 1024) // 64, (2 << band) // 64))
    return np.packbits((np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def keyed_sets(texts: DataFrame, often) -> DataFrame:
    """(cls, band, size, keys, parity) of each text with shingles, in each of its bands; ``often`` is a broadcast array in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = often.value
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for a, b in document_slices(offsets, SLICE):
                classes, n, shingles = word_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = [(cls, band, len(own), first_keys(own, band, frequent), parity(own, band)) for cls, own in zip(classes.view(np.int64).tolist(), split_sets(n, shingles), strict=True) for band in bands(len(own))]
                if out:
                    cls, band, size, keys, bits = zip(*out, strict=True)
                    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(band, pa.int32()), pa.array(size, pa.int64()), listed, pa.array(bits, pa.binary())], names=["cls", "band", "size", "keys", "parity"])

    return texts.select("text").mapInArrow(released(run), "cls long, band int, size long, keys array<long>, parity binary")


def similar_pairs(end: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each class with all of its unit that have another root and, by sizes and parities, may be similar."""
    cls, root, size, bits = rows[3:]
    lengths = np.array([len(x) for x in bits], np.int64)
    words = np.zeros((WIDE, len(cls)), np.uint64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        words[: n // 8, at] = np.frombuffer(b"".join(bits[at].tolist()), np.uint64).reshape(len(at), -1).T
    above, below = SIMILAR
    at, step = np.arange(len(end)), 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            return
        a = at[root[at] != root[at + step]]
        a = a[np.minimum(size[a], size[a + step]) * below >= np.maximum(size[a], size[a + step]) * above]
        apart = np.zeros(len(a), np.int64)
        for k, own in enumerate(words):
            if not len(a):
                break
            apart += np.bitwise_count(own[a] ^ own[a + step])
            # similar sets differ in (below - above) / (below + above) of both together at most
            if k in (0, 3, 15, WIDE - 1):
                close = apart * (below + above) <= (size[a] + size[a + step]) * (below - above)
                a, apart = a[close], apart[close]
        if len(a):
            yield cls[a], cls[a + step]


def missed(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a > b: all classes of ``texts`` (one text a class) of different ``roots`` (node, root) that may be similar."""
    context = texts.sparkSession.sparkContext
    counted = keyed_sets(texts, context.broadcast(np.zeros(0, np.uint64))).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = materialize(counted.filter(F.col("n") > OFTEN), "often").orderBy(F.desc("n")).limit(FREQUENT).select("key").toArrow()
    sets = materialize(keyed_sets(texts, context.broadcast(np.sort(often.column("key").to_numpy().view(np.uint64)))), "keyed")
    own = roots.select(F.col("node").alias("cls"), "root")
    keyed = sets.join(own, "cls", "left").select("cls", "band", F.coalesce("root", "cls").alias("root"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    met = join_hot(keyed, materialize(shared.select("key", "n"), "shared"), ("key",), "n").withColumn("parts", F.ceil(F.col("n") / F.lit(UNIT)).cast("int"))
    dealt = in_parts(met, "root", "band").join(sets.select("cls", "band", "size", "parity"), ["cls", "band"])
    return close_pairs(dealt.select(*_UNIT, "cls", "root", "size", "parity"), similar_pairs)


def near_copies(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, *keep, component) for each row of ``docs`` (row long, unique; text), equal for near copies."""
    rows = materialize(signed_rows(docs, "row", *keep), "signatures")
    first = rows.groupBy("cls").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    classes = materialize(rows.select("cls", "row", *FINGERPRINT, "keys").join(first.select("row", "n"), "row"), "classes")
    keyed = classes.select("cls", *FINGERPRINT, F.explode("keys").alias("key"))
    tried = materialize(close_pairs(units(keyed.withColumn("root", F.col("cls"))), some_pairs), "pairs")
    some = materialize(tried.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "paired")
    members = materialize(keyed.join(some, "cls", "left_semi"), "members")
    met = classes.select("cls", "row").join(some, "cls", "left_semi")
    sets = materialize(shingle_sets(docs.select("row", "text").join(met, "row")), "sets")
    roots = components(verified(tried, sets))
    for every in (False, True):
        own = roots.select(F.col("node").alias("cls"), "root")
        dealt = units(members.join(own, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        if every:
            fine = sets.select("cls", F.size("shingles").alias("size"), "fine").join(classes.select("cls", "keys"), "cls")
            met = close_pairs(materialize(crowded(dealt), "crowded").join(fine, "cls").select(*_UNIT, "cls", "root", "size", "fine", "keys"), all_pairs)
        else:
            met = close_pairs(dealt, some_pairs)
        more = materialize(met.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(more, sets)))
            tried = tried.unionByName(more)
    copies = materialize(rows.select("row").join(classes.select("row"), "row", "left_anti"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies.hint("merge")
    more = materialize(missed(docs.select("row", "text").join(copies, "row", "left_anti"), roots).join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        new = more.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(some, "cls", "left_anti")
        sets = sets.unionByName(materialize(shingle_sets(docs.select("row", "text").join(classes.select("cls", "row").join(new, "cls"), "row")), "sets"))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(more, sets)))
    own = roots.withColumnRenamed("node", "cls")
    named = materialize(classes.select("cls", "n").join(own, "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("component")), "named")
    return join_hot(rows.select("row", *keep, "cls"), named, ("cls",), "n").select("row", *keep, "component")
