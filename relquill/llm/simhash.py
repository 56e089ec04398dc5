"""Operator 3, SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of each document's 3-word
shingles, A-Z lowered, words split at 09-0D and 20. Equal fingerprints are grouped
first; only distinct fingerprints are compared. Two fingerprints within 2 bits
agree on two of four 16-bit quarters, so six keys of quarter pairs bring every
link together. Inside a key's group the Hamming distances to ``PIVOTS`` reference
fingerprints are tabled once, pairs whose distances to some pivot differ by more
than 2 are discarded (triangle inequality), and the survivors are compared.

Groups above ``GROUP`` fingerprints are dealt again, over the 120 ways to agree on
14 of 16 four-bit parts: such a group has at most 256 members, so every task is
bounded and nothing is capped. A group yields links to its parts' smallest member,
never all pairs. Components: alternating large-star and small-star steps on the
links, each written to the shared folder.

Null text or no words: fingerprint zero, linked like any other. Fewer than three
words: the whole sequence is the shingle. Null doc_id: a row like others, ignored
by the minimum. Very long texts are hashed whole, a part of the votes at a time. Bits that
half of the hashes set are 0, so ties need no rule. Repeated rows keep their rows. Extra
columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import batch_of, column, documents, join_hot, materialize, mix, released, text_bytes, word_spans

WORDS, DISTANCE, PIVOTS, GROUP = 3, 2, 16, 2048

_REFERENCE = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def fingerprints(column_: pa.Array, words: int = WORDS) -> np.ndarray:
    """One 64-bit fingerprint (as uint64) for each text of a string column."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, offsets = text_bytes(column_)
    data = _LOWER[data]
    out = np.zeros(len(offsets) - 1, np.uint64)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    for d in range(len(out)):
        a, b = int(first[d]), int(first[d + 1])
        if a == b:
            continue
        s, e = starts[a:b], ends[a:b]
        sizes = e - s
        # the document again, with one space between words
        base = int(s[0])
        own = data[base : int(e[-1])]
        if len(own) != int(sizes.sum()) + len(sizes) - 1:
            white = _WHITE[own]
            own = own[~(white & np.concatenate([[False], white[:-1]]))]
        text = np.where(_WHITE[own], np.uint8(32), own).tobytes()
        at = np.zeros(len(sizes), np.int64)
        np.cumsum(sizes[:-1] + 1, out=at[1:])
        n = max(1, len(sizes) - words + 1)
        to = (at + sizes)[min(words, len(sizes)) - 1 :]
        h = np.fromiter((digest(text[i:j], 42) for i, j in zip(at[:n].tolist(), to.tolist(), strict=True)), np.uint64, n)
        out[d] = majority(h)
    return out


def majority(h: np.ndarray) -> np.uint64:
    """A bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">u8")[0]


def with_fingerprints(docs: DataFrame, *keep: str, words: int = WORDS) -> DataFrame:
    """(*keep, fp long) for each row of ``docs``, which has a text column."""
    kept = docs.select(*keep, "text")
    schema = kept.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(column(batch, "text"), words).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), fp], names=[*keep, "fp"])

    return kept.mapInArrow(released(run), schema)


# --- links ---------------------------------------------------------------------


def local_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its part) for the linked ones of distinct fingerprints."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ _REFERENCE[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 1], table[:, 0]))
    fps, table = fps[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        j = np.arange(i + 1, reach[i])
        if not len(j):
            continue
        for k in range(1, PIVOTS, 5):
            j = j[(np.abs(table[j, k : k + 5] - table[i, k : k + 5]) <= distance).all(axis=1)]
            if not len(j):
                break
        for m in j[np.bitwise_count(fps[j] ^ fps[i]) <= distance].tolist():
            a, b = root(i), root(m)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(n)])
    least = np.full(n, np.iinfo(np.int64).max)
    signed = fps.view(np.int64)
    np.minimum.at(least, roots, signed)
    smallest = least[roots]
    linked = smallest != signed
    return signed[linked], smallest[linked]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())])


def group_links(distinct: DataFrame, parts: int, agree: int, most: int) -> DataFrame:
    """Links (a, b) inside each group of fingerprints that agree on ``agree`` of ``parts``
    parts; members of groups above ``most`` come back once more as (a, null, dense)."""
    width = 64 // parts
    masks = []
    for chosen in combinations(range(parts), agree):
        m = 0
        for c in chosen:
            m |= ((1 << width) - 1) << (c * width)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("way", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # fingerprints of the group that is open
        key, size, dense = None, 0, False
        out: list[list] = [[], [], []]

        def put(a, b, d) -> None:
            out[0].append(a)
            out[1].append(b)
            out[2].append(np.full(len(a), d))

        def close() -> None:
            if size > 1 and not dense:
                a, b = local_links(np.unique(np.concatenate(held)).view(np.uint64))
                if len(a):
                    put(a, b, False)

        def emit() -> Iterator[pa.RecordBatch]:
            if out[0]:
                a, b, d = (np.concatenate(x) for x in out)
                yield batch_of(LINKS, a, pa.array(b, pa.int64(), mask=d), d)
                for x in out:
                    x.clear()

        for batch in batches:
            way, part, fp = (column(batch, c).to_numpy() for c in ("way", "part", "fp"))
            cut = np.flatnonzero((way[1:] != way[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *cut.tolist(), len(fp)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                if (way[a], part[a]) != key:
                    close()
                    held, key, size, dense = [], (way[a], part[a]), 0, False
                size += b - a
                if not dense:
                    held.append(fp[a:b])
                    if size > most:
                        dense = True
                        every = np.concatenate(held)
                        put(every, every, True)
                        held = []
                else:
                    put(fp[a:b], fp[a:b], True)
            yield from emit()
        close()
        yield from emit()

    return keyed.repartition(F.col("way"), F.col("part")).sortWithinPartitions("way", "part").mapInArrow(released(run), "a long, b long, dense boolean")


def link_table(distinct: DataFrame) -> DataFrame:
    """All links needed for the components of fingerprints within 2 bits: (a, b), a > b."""
    first = materialize(group_links(distinct, 4, 2, GROUP), "simhash-links")
    links = first.filter("not dense").select("a", "b")
    dense = first.filter("dense").select(F.col("a").alias("fp")).distinct()
    # in these groups at most 256 fingerprints can differ
    again = group_links(dense, 16, 14, 256).select("a", "b")
    return links.unionByName(again).distinct()


def checksum(links: DataFrame) -> tuple:
    """Equal for equal sets of links (u, v): their number and two sums of their hashes."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root its component's smallest node."""
    links = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = checksum(links)
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        links = materialize(small, "links")
        after = checksum(links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text): components of fingerprints within 2 bits."""
    rows = materialize(with_fingerprints(docs, "doc_id"), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "classes")
    roots = components(link_table(classes.select("fp")))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(placed.join(least, "root").select("fp", "component_id", "n"), "named")
    return join_hot(rows, named, ("fp",), "n").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text): components of
    near copies as the pipeline's stage takes them (``nearcopies``), not of fingerprints."""
    from relquill.llm.nearcopies import near_copies

    numbered = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = near_copies(numbered, "doc_id")
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return groups.join(with_fingerprints(numbered, "row"), "row").join(least, "component").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
