"""Operator 6, benchmark decontamination by CGK embedding and bit-sampling LSH.

An item leaks where some stretch of a document is within ``MAX_EDIT`` times its length
of edits (bytes, after the case of all letters is folded and white space made a
space; spans are those of the text as it stands).

1. Places that cannot hold an item are passed over without loss: within k edits of an
   item of m bytes at least m - 7 - 8 k of its 8-byte strings survive, and their
   places less their places in the item (diagonals) differ by at most k. So a copy begins
   within k of a run of that many diagonals that lie within k of each other; each such run
   is a region of one item, and copies that do not overlap have regions of their own.
2. Item-sized windows at the diagonals and word starts of a region are embedded by CGK random
   walks (edit distance becomes Hamming distance), and ``TABLES`` tables of ``SAMPLES``
   sampled positions over ``WALKS`` walks name the regions whose embedding agrees with the
   item's in a table, at the recall that the tests measure.
3. Named regions are verified by exact edit distance (bit-parallel, semi-global). Every
   copy is reported: from left to right the stretches that do not overlap, each that of fewest
   edits about its place, and of those the shortest.

Equal items are looked for once and reported for each of their ids. Distinct items are sent to
the executors in blocks of about ``ITEMS`` texts or ``BLOCK_BYTES`` bytes, each block a
pass of its own over the documents, so a broadcast has a bound beside its longest item, and
passes grow with the benchmark, not with the documents. Items above ``LONG`` bytes are verified
at once in every region that the filter leaves, without walks. Items below ``SHORTEST`` bytes are
cut into one piece more than their edits; one piece survives, and where one is found the
item is verified, so these lose nothing. Null or empty items leak nowhere. Null or empty
text: no leak. Very long texts are searched whole. Repeated rows are found each, and ties
between items are all reported. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import batch_of, column, document_slices, documents, gram_hashes, mix, plain_names, prefix_hash, released, scatter_index, text_bytes

MAX_EDIT, GRAM, SHORTEST = 0.1, 8, 40
WALKS, TABLES, SAMPLES = 8, 48, 4
ITEMS, BLOCK_BYTES, SLICE = 5000, 1 << 22, 1 << 23
#: Bytes above which items are not embedded; steps after which a walk's coins repeat; bytes of windows embedded at once.
LONG, COINS, EMBEDDED = 1 << 15, 1 << 14, 1 << 25
#: Places of strings, of all items, that the filter holds at once; beyond it documents go one by one, then items.
COUNTED = 1 << 22
#: Items whose lengths differ by less than this factor share windows.
GROWTH = 1.15

LEAKS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
LEAKS_DDL = "doc_id long, key long, start long, end long, edits long"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 32


def allowed(m: int) -> int:
    """Edits allowed for an item of m bytes; from ``SHORTEST`` bytes on, a gram survives them."""
    return math.floor(MAX_EDIT * m)


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of each folded code point (up to 6) and how many; 0 where folding changes nothing or the point is ASCII."""
    size, to = np.zeros(0x1F000, np.uint8), np.zeros((0x1F000, 6), np.uint8)
    for c in range(128, len(size)):
        if not 0xD800 <= c < 0xE000 and (folded := chr(c).casefold()) != chr(c):
            raw = folded.encode()
            size[c] = len(raw)
            to[c, : len(raw)] = list(raw)
    return size, to


class Folded:
    """Bytes with the case of all letters folded and white space made a space, and the way back."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size, to = _folds()
        plain = _PLAIN[data]
        lead = np.flatnonzero(data >= 0xC2)
        first = data[lead].astype(np.int64)
        long = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        point = first & np.where(long == 2, 0x1F, np.where(long == 3, 0x0F, 0x07))
        whole = lead + long <= len(data)
        for k in (1, 2, 3):
            more = long > k
            c = data[np.minimum(lead + k, len(data) - 1)] if len(lead) else first
            whole &= ~more | (c & 0xC0 == 0x80)
            point = np.where(more, point << 6 | (c & 0x3F), point)
        changed = whole & (point < len(size))
        changed[changed] = size[point[changed]] > 0
        at, old, point = lead[changed], long[changed], point[changed]
        new = size[point].astype(np.int64)
        for n in (2, 3, 4):
            same = (old == n) & (new == n)
            plain[at[same, None] + np.arange(n)] = to[point[same], :n]
        other = old != new
        #: where letters change their length: first byte, bytes before and after folding, shift of what follows
        self.at, self.old, self.new = at[other], old[other], new[other]
        self.shift = np.concatenate([[0], np.cumsum(self.new - self.old)])
        self.begin = self.at + self.shift[:-1]
        if len(self.at):
            parts, end = [], 0
            for a, n, letter, m in zip(self.at.tolist(), self.old.tolist(), point[other].tolist(), self.new.tolist(), strict=True):
                parts += [plain[end:a], to[letter, :m]]
                end = a + n
            plain = np.concatenate([*parts, plain[end:]])
        self.data, self.offsets = plain, offsets + self.shift[np.searchsorted(self.at, offsets)]

    def back(self, place: int, end: bool) -> int:
        """The original byte of a start or end in the folded bytes."""
        i = int(np.searchsorted(self.begin, place, side="left" if end else "right")) - 1
        if i >= 0 and place < self.begin[i] + self.new[i]:
            return int(self.at[i] + (self.old[i] if end else 0))
        return int(place - self.shift[i + 1])


def gram_words(data: np.ndarray) -> np.ndarray:
    """Every GRAM-byte string as an integer."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def near_ends(pattern: bytes, text: bytes, most: int) -> list[tuple[int, int]]:
    """(end, edits) of the ends of stretches of the text within ``most`` edits of the pattern.

    Myers' bit-parallel column in one wide integer.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= most:
            out.append((j + 1, score))
    return out


def copies(pattern: bytes, text: bytes, most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the copies of the pattern, from left to right, none overlapping."""
    ends, i, free, out = near_ends(pattern, text, most), 0, 0, []
    least = len(pattern) - most
    while i < len(ends):
        j = i
        # the ends that one copy explains lie within twice its edits
        while j < len(ends) and ends[j][0] <= ends[i][0] + 2 * most:
            j += 1
        end = min(ends[i:j], key=lambda e: (e[1], e[0]))[0]
        back = near_ends(pattern[::-1], text[free:end][::-1], most)
        if back:
            size, edits = min(back, key=lambda e: (e[1], e[0]))
            out.append((end - size, end, edits))
            free = end
            while i < len(ends) and ends[i][0] < free + least:
                i += 1
        else:  # only with bytes of the copy before
            i += 1
    return out


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of (start, end, edits) that do not overlap one of fewer edits, or as many and further left."""
    out: list[tuple[int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (x[2], x[0], x[1])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
            out.append(x)
    return sorted(out)


class Items:
    """A block of benchmark items: gram filter, length groups and LSH tables."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts, self.short = [], [], []
        short_ids = []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            plain = Folded(raw, np.array([0, len(raw)])).data
            if len(plain) >= SHORTEST:
                self.ids.append(item)
                self.texts.append(plain)
            elif len(plain):
                short_ids.append(item)
                self.short.append(plain)
        self.ids += short_ids  # short items come after the others
        pieces: dict[int, list] = {}
        for o, t in enumerate(self.short):
            n = len(t) // (allowed(len(t)) + 1)
            h = gram_hashes(prefix_hash(t), n)
            pieces.setdefault(n, []).extend((int(h[k]), o, k) for k in range(0, n * allowed(len(t)) + 1, n))
        self.pieces = []
        for n, found in sorted(pieces.items()):
            found.sort()
            self.pieces.append((n, np.array([f[0] for f in found], np.uint64), [f[1:] for f in found]))
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([allowed(n) for n in self.sizes.tolist()], np.int64)
        self.need = self.sizes - GRAM + 1 - GRAM * self.edits
        # all strings of the items: where each stands, string by string
        words = [gram_words(t) for t in self.texts]
        self.grams, of = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        by = np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[by], np.arange(len(self.grams) + 1))
        self.item = np.repeat(np.arange(len(words)), [len(w) for w in words])[by]
        self.place = np.concatenate([np.arange(len(w)) for w in words])[by] if words else np.zeros(0, np.int64)
        self.bits = np.uint64(64 - max(16, int(len(self.grams) * 16).bit_length()))
        self.known = np.zeros(1 << (64 - int(self.bits)), bool)
        self.known[self.slot(self.grams)] = True
        rng = np.random.default_rng(6)
        longest = max((len(t) for t in self.texts), default=0)
        self.walk_bits = rng.integers(0, 2, (WALKS, min(2 * longest + 2, COINS), 256), dtype=np.uint8)
        #: (width, sampled steps, items in order, their keys) of each group of embedded items
        self.groups, self.group = [], np.full(len(self.texts), -1, np.int64)
        order, at = np.argsort(self.sizes, kind="stable"), 0
        while at < len(order) and self.sizes[order[at]] <= LONG:
            least = int(self.sizes[order[at]])
            end = int(np.searchsorted(self.sizes[order], min(LONG, max(least, int(least * GROWTH))), side="right"))
            members = np.sort(order[at:end])
            width = int(self.sizes[members].max())
            # steps read within the walk over the shortest member, so that a group's windows serve all of it
            picks = np.sort(rng.integers(0, max(1, 2 * least - least // 4), (TABLES, SAMPLES)), axis=1)
            self.group[members] = len(self.groups)
            self.groups.append((width, picks, members, self.keys([self.texts[i] for i in members], width, picks)))
            at = end

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def keys(self, windows: list[np.ndarray], width: int, picks: np.ndarray) -> np.ndarray:
        """(windows, TABLES) keys: all CGK walks over each window, read at the sampled steps."""
        n, per = len(windows), TABLES // WALKS
        x = np.zeros((n, width + 1), np.uint8)
        for i, w in enumerate(windows):
            x[i, : min(width, len(w))] = w[:width]
        flat, base = x.ravel(), (np.arange(n) * (width + 1))[None, :]
        walks = np.arange(WALKS)[:, None]
        out = np.zeros((TABLES, n), np.uint64)
        steps: dict[int, list[int]] = {}
        for t, row in enumerate(picks.tolist()):
            for s in row:
                steps.setdefault(s, []).append(t)
        at = np.zeros((WALKS, n), np.int64)
        for s in range(int(picks.max()) + 1):
            c = flat[base + at]
            for t in steps.get(s, ()):
                out[t] = out[t] * np.uint64(0x100000001B3) + c[t // per] + np.uint64(1)
            at += self.walk_bits[:, s % self.walk_bits.shape[1]][walks, c]
            np.minimum(at, width, out=at)
        return mix(out * np.uint64(TABLES) + np.arange(TABLES, dtype=np.uint64)[:, None]).T

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first and last place where a copy may begin, a likely one)."""
        words = gram_words(data)
        at = np.flatnonzero(self.known[self.slot(words)])
        gram = np.minimum(np.searchsorted(self.grams, words[at]), len(self.grams) - 1)
        real = self.grams[gram] == words[at]
        at, gram = at[real], gram[real]
        doc = np.searchsorted(offsets, at, side="right") - 1
        whole = at + GRAM <= offsets[doc + 1]
        at, gram, doc = at[whole], gram[whole], doc[whole]
        places = self.first[gram + 1] - self.first[gram]
        # what a document costs: its places of strings, and one count an item
        cost = np.concatenate([[0], np.cumsum(np.bincount(doc, places, len(offsets) - 1).astype(np.int64) + len(self.texts))])
        out = []
        for a, b in document_slices(cost, COUNTED):
            i, j = np.searchsorted(doc, [a, b])
            if int(places[i:j].sum()) <= COUNTED:
                out += self.runs(at[i:j], gram[i:j], doc[i:j] - a, offsets[a : b + 1], a)
            else:
                out += self.runs_of_one(at[i:j], gram[i:j], offsets[a : b + 1], a)
        return out

    def runs(self, at: np.ndarray, gram: np.ndarray, doc: np.ndarray, offsets: np.ndarray, base: int) -> list[tuple[int, int, int, int, int]]:
        """Regions of some documents from the places of the strings that they share with items."""
        places = self.first[gram + 1] - self.first[gram]
        listed = scatter_index(self.first[gram], places)
        code = np.repeat(doc, places) * len(self.texts) + self.item[listed]
        # (document, item) pairs that share fewer strings than survive the edits are none
        enough = np.bincount(code, minlength=1)[code] >= self.need[self.item[listed]]
        code, diagonal = code[enough], (np.repeat(at, places) - self.place[listed])[enough]
        return self.runs_along(code, diagonal, offsets, base)

    def runs_of_one(self, at: np.ndarray, gram: np.ndarray, offsets: np.ndarray, base: int) -> list[tuple[int, int, int, int, int]]:
        """The same for one document of too many places, item by item; an item of too many is sought in the whole document."""
        strings, often = np.unique(gram, return_counts=True)
        places = self.first[strings + 1] - self.first[strings]
        listed = scatter_index(self.first[strings], places)
        total = np.bincount(self.item[listed], np.repeat(often, places), len(self.texts)).astype(np.int64)
        out = []
        for o in np.flatnonzero(total >= self.need).tolist():
            if total[o] > COUNTED:
                out.append((base, o, int(offsets[0]), int(offsets[1]), int(offsets[0])))
                continue
            grams, first, n = np.unique(np.searchsorted(self.grams, gram_words(self.texts[o])), return_index=True, return_counts=True)
            own = gram_words(self.texts[o])
            order = np.argsort(np.searchsorted(self.grams, own), kind="stable")
            first = np.cumsum(n) - n
            hit = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            real = grams[hit] == gram
            listed = order[scatter_index(first[hit[real]], n[hit[real]])]
            diagonal = np.repeat(at[real], n[hit[real]]) - listed
            out += self.runs_along(np.full(len(diagonal), o), diagonal, offsets, base)
        return out

    def runs_along(self, code: np.ndarray, diagonal: np.ndarray, offsets: np.ndarray, base: int) -> list[tuple[int, int, int, int, int]]:
        """Regions from (document * items + item, diagonal) of strings, in any order."""
        by = np.lexsort((diagonal, code))
        code, diagonal = code[by], diagonal[by]
        item = code % max(1, len(self.texts))
        i = np.arange(len(code))
        j = i + self.need[item] - 1
        i, j = i[j < len(code)], j[j < len(code)]
        i, j = i[code[i] == code[j]], j[code[i] == code[j]]
        k = self.edits[item[i]]
        close = diagonal[j] - diagonal[i] <= k
        i, j, k = i[close], j[close], k[close]
        doc, item = code[i] // max(1, len(self.texts)), item[i]
        lo, hi = np.maximum(diagonal[j] - k, offsets[doc]), np.minimum(diagonal[i] + k, offsets[doc + 1] - self.sizes[item] + k)
        fits = lo <= hi
        lo, hi, doc, item, likely = lo[fits], hi[fits], doc[fits], item[fits], diagonal[(i + j) // 2][fits]
        if not len(lo):
            return []
        # runs are in order of their first places; those that meet are one region
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
        cut = np.flatnonzero(np.concatenate([[True], ~same | (lo[1:] > hi[:-1] + 1)]))
        last = np.append(cut[1:], len(lo)) - 1
        middle = (cut + last) // 2
        return list(zip((doc[cut] + base).tolist(), item[cut].tolist(), np.minimum.reduceat(lo, cut).tolist(), np.maximum.reduceat(hi, cut).tolist(), likely[middle].tolist(), strict=True))

    def named(self, data: np.ndarray, offsets: np.ndarray, found: list[tuple], g: int) -> list[tuple]:
        """The regions of a group that have a window which shares a key with their item."""
        width, picks, members, item_keys = self.groups[g]
        windows, of = [], []
        for k, (doc, _, lo, hi, likely) in enumerate(found):
            begin, end = int(offsets[doc]), int(offsets[doc + 1])
            inside = np.arange(lo, hi + 1)
            words = inside[(inside == begin) | (data[inside - 1] == 32)]
            for s in {max(begin, likely), *words.tolist(), *range(lo, hi + 1, 16)}:
                windows.append(data[s : min(end, s + width)])
                of.append(k)
        own = np.searchsorted(members, [r[1] for r in found])
        stays, of = np.zeros(len(found), bool), np.array(of, np.int64)
        most = min(4096, EMBEDDED // (width + 1))
        for at in range(0, len(windows), most):
            region = of[at : at + most]
            agrees = (self.keys(windows[at : at + most], width, picks) == item_keys[own[region]]).any(axis=1)
            stays[region[agrees]] = True
        return [r for r, stay in zip(found, stays.tolist(), strict=True) if stay]

    def short_leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Leaks of short items: the best stretch about each run of their pieces."""
        stretches: dict[tuple[int, int], list] = {}
        prefix = prefix_hash(data) if self.pieces else None
        for n, hashes, of in self.pieces:
            values = gram_hashes(prefix, n)
            left = np.searchsorted(hashes, values)
            at = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == values)
            doc = np.searchsorted(offsets, at, side="right") - 1
            right = np.searchsorted(hashes, values[at], side="right")
            for p, d, a, b in zip(at.tolist(), doc.tolist(), left[at].tolist(), right.tolist(), strict=True):
                for o, k in of[a:b]:
                    m = len(self.short[o])
                    lo, hi = max(int(offsets[d]), p - k - allowed(m)), min(int(offsets[d + 1]), p - k + m + allowed(m))
                    if p + n <= hi:
                        stretches.setdefault((d, o), []).append((lo, hi))
        for (d, o), found in stretches.items():
            item, joined = self.short[o].tobytes(), []
            for lo, hi in sorted(found):
                if joined and lo < joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            spans = [(lo + x, lo + y, k) for lo, hi in joined for x, y, k in copies(item, data[lo:hi].tobytes(), allowed(len(item)))]
            for x, y, k in apart(spans):
                yield d, len(self.texts) + o, x - int(offsets[d]), y - int(offsets[d]), k

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item position, start, end, edits) of every copy of each item."""
        by_group: dict[int, list] = {}
        if len(self.grams):
            for r in self.regions(data, offsets):
                by_group.setdefault(int(self.group[r[1]]), []).append(r)
        spans: dict[tuple[int, int], list] = {}
        for g, found in sorted(by_group.items()):
            for doc, o, lo, hi, _ in self.named(data, offsets, found, g) if g >= 0 else found:
                end = min(int(offsets[doc + 1]), hi + int(self.sizes[o] + self.edits[o]))
                for x, y, k in copies(self.texts[o].tobytes(), data[lo:end].tobytes(), int(self.edits[o])):
                    spans.setdefault((doc, o), []).append((lo + x, lo + y, k))
        whole = [(d, o, x - int(offsets[d]), y - int(offsets[d]), k) for (d, o), found in spans.items() for x, y, k in apart(found)]
        return sorted([*whole, *self.short_leaks(data, offsets)])


def item_key(text):
    """What tells the texts of items apart."""
    return F.xxhash64(text)


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The distinct texts of the benchmark, by ``item_key``, in blocks of bounded size."""
    texts = benchmark.select("text").filter(F.col("text") != "").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil(size / BLOCK_BYTES))
    keyed = texts.select(item_key("text").alias("key"), "text")
    for b in range(blocks):
        part = keyed if blocks == 1 else keyed.filter(F.pmod(F.hash("text"), F.lit(blocks)) == b)
        yield Items(sorted((r["key"], r["text"]) for r in part.collect()))  # about ITEMS rows, BLOCK_BYTES bytes


def batch_leaks(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """Leaks of a string column, documents as row numbers."""
    data, offsets = text_bytes(texts)
    out = []
    for a, b in document_slices(offsets, SLICE):
        own = offsets[a : b + 1] - offsets[a]
        text = Folded(data[offsets[a] : offsets[b]], own)
        for d, o, start, end, edits in items.leaks(text.data, text.offsets):
            base = int(text.offsets[d])
            out.append((a + d, o, text.back(base + start, False) - int(own[d]), text.back(base + end, True) - int(own[d]), edits))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits), byte spans, of every leaked item found."""
    sc = docs.sparkSession.sparkContext
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for items in item_blocks(benchmark):
        shared = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = column(batch, "doc_id").to_pylist()
                found = batch_leaks(column(batch, "text"), shared.value)
                if found:
                    yield batch_of(LEAKS, *zip(*((doc[d], shared.value.ids[o], s, e, k) for d, o, s, e, k in found), strict=True))

        part = rows.mapInArrow(released(run), LEAKS_DDL)
        out = part if out is None else out.unionByName(part)
    ids = benchmark.select(item_key("text").alias("key"), F.col("item_id").cast("long").alias("item_id"))
    return out.join(ids, "key").select("doc_id", "item_id", "start", "end", "edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a leaked item; one pass, no shuffle."""
    sc, names = docs.sparkSession.sparkContext, docs.columns
    docs = docs.toDF(*plain_names(names))
    for items in item_blocks(benchmark):
        shared = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[r[0] for r in batch_leaks(column(batch, "text"), shared.value)]] = False
                yield batch if stays.all() else batch.filter(pa.array(stays))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs.toDF(*names)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
