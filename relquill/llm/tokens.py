"""Operator 2, token ids in binary shards with a minimal perfect hash index.

Shard ``part-NNNNNNN-NNNNN`` (task, its shard): ``.ids`` (raw little-endian ids, 16 bits where the vocabulary
fits, else 32) and ``.idx`` (header, seeds, slots, keys, sizes). The index is a minimal perfect
hash of the shard's distinct document keys by hash and displace: keys fall into
buckets, largest first each bucket gets the first seed that sends its keys to free
slots; a slot holds a 32-bit fingerprint, where the key's ids start, how many there are,
and its records. A lookup reads the header, one seed and one slot, whose fingerprint
rejects foreign keys, and then the ids, whatever the shard's size; the table of all records
is read through the same index, its ids in one stream a shard.

Control strings of the tokenizer in a text (added tokens such as its end-of-text mark) become
their own ids, as the tokenizers library has it without further switches.

Documents are dealt by range of (doc_id, hash of the text, row number) and sorted so, so
shards follow each other in ascending doc_id order (null first) and an id of many rows
is split; ``docs`` must be a stable table, read alike by each attempt. A task closes a shard at
``SHARD_RECORDS`` records or ``SHARD_IDS`` ids, so an index has a bound at any number
of partitions; the manifest keeps each shard's least and largest id, by which
``TokenStore`` finds the shards of a key. Null text: empty. Very long texts are one record,
encoded whole. Repeated ids: one record each, in the order of the texts' hashes; an index
names a run by its first record. Null ids are stored but cannot be looked up. Empty table:
no shards, no rows. Extra columns are ignored. A shard is written under a temporary name
and moved when whole, so lost executors and repeated attempts leave equal files.
"""

from __future__ import annotations

import posixpath
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import ShardFile, batch_of, column, document_slices, documents, filesystem, mix, partition_id, released, run_dir, scatter_index, spread

MAGIC = b"RQTOK2\0\0"
END_ID = 0
#: Distinct pre-tokens whose ids a worker remembers (about 150 bytes each).
CACHE_ENTRIES = 1_000_000
#: Records and ids at which a shard is closed.
SHARD_RECORDS, SHARD_IDS = 1 << 20, 1 << 28
#: Bytes of ids read at once from a shard's stream (one record may be longer).
READ = 1 << 23


# --- encoding ----------------------------------------------------------------


# Letters, digits and white space among the first 256 code points (fixed values).
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t-\r\x85\xa0"
#: The tokenizer's own pattern over those classes.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


class _Slots(dict):
    """Numbers pre-tokens in order of their first appearance."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Byte-level BPE with the ids of pre-tokens remembered.

    Byte-level BPE merges never cross pre-tokens, so a text's ids are those of its
    pre-tokens in turn. Each distinct pre-token is encoded by the tokenizers library
    once per ``CACHE_ENTRIES``; texts are then joined from the remembered ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_any = regex.compile(public_tokenizers.PATTERN).findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        # texts are parted at these before anything else, the longest first
        self.marks = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")") if added else None
        self.whole = self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added)
        vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
        # ids whose text begins with a space (byte-level alphabet: G with a dot)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(vocabulary)])
        self.newline = self._ids("\n")
        self.reset()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, added tokens among them."""
        if self.whole:  # a tokenizer whose words depend on what is around them
            return [text]
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        parts = self.marks.split(text)
        return [w for i, part in enumerate(parts) for w in ((part,) if i % 2 else self.plain(part))]

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens; of Latin-1 texts by a pattern with its classes spelled out."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return _LATIN(text)

    def reset(self) -> None:
        self.slots = _Slots()
        self.ids = np.zeros(1 << 20, self.dtype)
        self.at = np.zeros(1 << 18, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of each.

        Runs of letters are encoded in one text: with a leading space their first
        id begins with a space and no other does; without, a line end parts them.
        """
        kinds = [(2 if w[0] == " " and w[1:].isalpha() else 1) if w.lstrip(" ").isalpha() and len(self.newline) == 1 and w.count(" ") == (w[0] == " ") else 0 for w in words]
        sizes, pieces, order = np.zeros(len(words), np.int64), [], []
        for kind in (0, 1, 2):
            own = [i for i, k in enumerate(kinds) if k == kind]
            if not own:
                continue
            if kind == 0:
                got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in own], add_special_tokens=False)]
                ids, first = np.array([x for g in got for x in g], np.int64), None
                sizes[own] = [len(g) for g in got]
            elif kind == 1:
                ids = self._ids("\n" + "\n".join(words[i] for i in own))
                marks = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
                first = np.diff(marks) - 1
                ids = ids[ids != self.newline[0]]
            else:
                ids = self._ids("".join(words[i] for i in own))
                first = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
            if first is not None:
                if len(first) != len(own):  # a tokenizer that parts words otherwise
                    return self._one_by_one(words)
                sizes[own] = first
            pieces.append(ids)
            order += own
        flat, place = np.concatenate(pieces), np.array(order)
        # back into the order of the words
        ends = np.zeros(len(words), np.int64)
        ends[place] = np.cumsum(sizes[place])
        return flat[scatter_index(ends - sizes, sizes)], sizes

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for g in got for x in g], np.int64), np.array([len(g) for g in got], np.int64)

    def learn(self) -> None:
        """Encode the pre-tokens that were numbered since the last call."""
        words, n = self.slots.new, len(self.slots)
        if not words:
            return
        self.slots.new = []
        ids, sizes = self._encoded(words)
        filled = int(self.at[n - len(words)])
        while filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[filled : filled + len(ids)] = ids
        self.at[n - len(words) + 1 : n + 1] = filled + np.cumsum(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end id, and the ids per text."""
        if len(self.slots) > CACHE_ENTRIES:
            self.reset()
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.split(text)
            words += found
            counts.append(len(found))
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        self.learn()
        starts = self.at[slot]
        sizes = self.at[slot + 1] - starts
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        closing = ends[np.cumsum(counts)] + np.arange(len(texts)) if texts else np.zeros(0, np.int64)
        out = np.full(int(ends[-1]) + len(texts), END_ID, self.dtype)
        body = np.ones(len(out), bool)
        body[closing] = False
        out[body] = self.ids[scatter_index(starts, sizes)]
        return out, np.diff(closing, prepend=-1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- minimal perfect hash ------------------------------------------------------


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(seed, np.uint64) * np.uint64(0xBF58476D1CE4E5B9)))


SLOT = np.dtype([("print", "<u4"), ("run", "<u4"), ("first", "<i8"), ("start", "<i8"), ("length", "<i8")])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)


def slot_of(keys: np.ndarray, seeds: np.ndarray, slots: int) -> np.ndarray:
    return (_hash(keys, seeds) % np.uint64(slots)).astype(np.int64)


class PerfectIndex:
    """Minimal perfect hash over distinct int64 keys, four keys to a bucket."""

    def __init__(self, seeds: np.ndarray, slots: np.ndarray):
        self.seeds, self.slots = seeds, slots

    @classmethod
    def build(cls, keys: np.ndarray, first: np.ndarray, run: np.ndarray, start: np.ndarray, length: np.ndarray) -> PerfectIndex:
        n = len(keys)
        buckets = max(1, (n + 3) // 4)
        seeds = np.zeros(buckets, np.uint32)
        place = np.full(n, -1, np.int64)
        if n:
            bucket = bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            starts = np.cumsum(sizes) - sizes
            free = np.ones(n, bool)
            tries = np.arange(1, 65, dtype=np.uint64)
            for b in np.argsort(-sizes, kind="stable"):
                if not sizes[b]:
                    break
                own = order[starts[b] : starts[b] + sizes[b]]
                base = np.uint64(0)
                while True:
                    want = slot_of(keys[own][None, :], (tries + base)[:, None], n)
                    ok = free[want].all(axis=1)
                    if len(own) > 1:
                        ranked = np.sort(want, axis=1)
                        ok &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                    if ok.any():
                        k = int(np.argmax(ok))
                        seeds[b] = int(tries[k] + base)
                        place[own] = want[k]
                        free[want[k]] = False
                        break
                    base += np.uint64(64)
        slots = np.zeros(n, SLOT)
        for name, values in (("print", fingerprint(keys)), ("run", run), ("first", first), ("start", start), ("length", length)):
            slots[name][place] = values
        return cls(seeds, slots)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where its fingerprint says that it is not there."""
        n = len(self.slots)
        if not n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        slot = slot_of(keys, self.seeds[bucket_of(keys, len(self.seeds))], n)
        return np.where(self.slots["print"][slot] == fingerprint(keys), slot, -1)

    def dump(self) -> bytes:
        return self.seeds.astype("<u4").tobytes() + self.slots.tobytes()


# --- shards --------------------------------------------------------------------

#: Magic, records, bytes an id, seeds, slots.
HEAD = struct.Struct("<8sQQQQ")
MANIFEST = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
MANIFEST_DDL = "shard long, name string, records long, tokens long, low long, high long"
RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class ShardWriter:
    """One shard: ids as they come, and the index when it is closed."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.folder, self.name, self.dtype = folder, name, dtype
        self.ids = ShardFile(folder, f"{name}.ids")
        self.keys, self.valid, self.sizes, self.records, self.tokens = [], [], [], 0, 0

    def add(self, doc: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.write(ids.tobytes())
        self.valid.append(doc.is_valid().to_numpy(zero_copy_only=False))
        self.keys.append(doc.fill_null(0).to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)
        self.records, self.tokens = self.records + len(sizes), self.tokens + len(ids)

    def close(self, number: int) -> pa.RecordBatch:
        """Finish both files; the shard's row of the manifest."""
        self.ids.close()
        key, valid, size = np.concatenate(self.keys).astype("<i8"), np.concatenate(self.valid), np.concatenate(self.sizes).astype("<i8")
        ends = np.concatenate([[0], np.cumsum(size)])
        own = np.flatnonzero(valid)
        distinct, first, run = np.unique(key[own], return_index=True, return_counts=True)
        first = own[first]
        index = PerfectIndex.build(distinct, first, run, ends[first], ends[first + run] - ends[first])
        out = ShardFile(self.folder, f"{self.name}.idx")
        out.write(HEAD.pack(MAGIC, len(key), self.dtype.itemsize, len(index.seeds), len(index.slots)))
        for part in (index.dump(), key.tobytes(), valid.astype(np.uint8).tobytes(), size.tobytes()):
            out.write(part)
        out.close()
        low, high = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return batch_of(MANIFEST, [number], [self.name], [self.records], [self.tokens], [low], [high])


def write_token_shards(docs: DataFrame, tokenizer_path: str, folder: str, tasks: int | None = None, records: int = SHARD_RECORDS) -> list:
    """Write ``docs`` (doc_id, text) below ``folder``; the manifest, one row a shard, in order.

    A shard of ``records`` records or more (at most 255 more) is closed.
    """
    n = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, out, done = partition_id(), encoder(tokenizer_path), None, 0
        for batch in batches:
            doc = column(batch, "doc_id")
            texts = column(batch, "text").to_pylist()
            for at in range(0, len(texts), 256):
                if out is None:
                    out = ShardWriter(folder, f"part-{task:07d}-{done:05d}", enc.dtype)
                out.add(doc.slice(at, 256), *enc.encode([t or "" for t in texts[at : at + 256]]))
                if out.records >= records or out.tokens >= SHARD_IDS:
                    yield out.close((task << 24) + done)
                    out, done = None, done + 1
        if out is not None:
            yield out.close((task << 24) + done)

    tie = [F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *tie)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    written = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(released(run), MANIFEST_DDL)
    # one row for each shard; drivers hold manifests of any corpus
    return sorted(written.collect(), key=lambda r: r["shard"])


class Shard:
    """A written shard, for lookups by key: each reads a seed, a slot and its ids, nothing else."""

    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        self.index, self.ids = (fs.open_input_file(posixpath.join(base, f"{name}.{kind}")) for kind in ("idx", "ids"))
        magic, self.records, width, self.buckets, self.slots = HEAD.unpack(self.index.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no token index")
        self.dtype = np.dtype(f"<u{width}")
        self.slots_at = HEAD.size + 4 * self.buckets
        self.keys_at = self.slots_at + SLOT.itemsize * self.slots
        self.sizes_at = self.keys_at + 9 * self.records

    def part(self, kind: np.dtype | str, at: int, n: int = 1) -> np.ndarray:
        self.index.seek(at)
        return np.frombuffer(self.index.read(np.dtype(kind).itemsize * n), kind)

    def get(self, key: int) -> list[np.ndarray]:
        """All records of a document key; none if the shard lacks it."""
        if not self.slots:
            return []
        keys = np.array([key], np.int64)
        seed = self.part("<u4", HEAD.size + 4 * int(bucket_of(keys, self.buckets)[0]))
        slot = self.part(SLOT, self.slots_at + SLOT.itemsize * int(slot_of(keys, seed, self.slots)[0]))[0]
        if slot["print"] != fingerprint(keys)[0] or self.part("<i8", self.keys_at + 8 * int(slot["first"]))[0] != key:
            return []
        self.ids.seek(int(slot["start"]) * self.dtype.itemsize)
        ids = np.frombuffer(self.ids.read(int(slot["length"]) * self.dtype.itemsize), self.dtype)
        if slot["run"] == 1:
            return [ids]
        return np.split(ids, np.cumsum(self.part("<i8", self.sizes_at + 8 * int(slot["first"]), int(slot["run"])))[:-1])

    def whole(self) -> tuple[PerfectIndex, np.ndarray, np.ndarray, np.ndarray]:
        """The index, and each record's key, whether it has one, and its size; of bounded length."""
        self.index.seek(HEAD.size)
        raw = self.index.read()
        seeds = np.frombuffer(raw, "<u4", self.buckets)
        slots, keys, valid, sizes = (np.frombuffer(raw, kind, n, at - HEAD.size) for kind, n, at in ((SLOT, self.slots, self.slots_at), ("<i8", self.records, self.keys_at), ("u1", self.records, self.keys_at + 8 * self.records), ("<i8", self.records, self.sizes_at)))
        return PerfectIndex(seeds, slots), keys, valid.astype(bool), sizes

    def located(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, has one, start, size) of each record: its key looked up in the index, a run's later records after its first."""
        index, keys, valid, sizes = self.whole()
        start = np.cumsum(sizes) - sizes
        own = np.flatnonzero(valid)
        if len(own):
            first = own[np.concatenate([[True], keys[own[1:]] != keys[own[:-1]]])]
            at = index.lookup(keys[first])
            found = index.slots[at]
            run = np.diff(np.append(first, own[-1] + 1))
            if (at < 0).any() or (found["first"] != first).any() or (found["run"] != run).any():
                raise ValueError("a key isn't found by its index")
            within = start[own] - np.repeat(start[first], run)
            start = start.copy()
            start[own] = np.repeat(found["start"], run) + within
        return keys, valid, start, sizes


class TokenStore:
    """Keyed access over all shards: those whose ids enclose the key, then their indexes."""

    def __init__(self, folder: str, manifest: list):
        self.folder = folder
        self.rows = [r for r in manifest if r["low"] is not None]
        self.highs = [r["high"] for r in self.rows]
        self.opened: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """All records of a document key, in their order; none if there is no such document."""
        out = []
        # shards follow each other, so those of a key stand side by side
        for r in self.rows[bisect_left(self.highs, key) :]:
            if r["low"] > key:
                break
            if r["name"] not in self.opened:
                self.opened[r["name"]] = Shard(self.folder, r["name"])
            out += self.opened[r["name"]].get(key)
        return out


def read_token_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row a record, by key through the index: (doc_id, start, n_tokens, ids_crc32)."""
    start, rows = 0, []
    for r in manifest:
        rows.append((r["shard"], r["name"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, base in zip(column(batch, "name").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                shard = Shard(folder, name)
                keys, valid, first, sizes = shard.located()
                ends = np.append(first, first[-1] + sizes[-1]) * shard.dtype.itemsize
                if (np.diff(ends) != sizes * shard.dtype.itemsize).any():
                    raise ValueError(f"{name}: its records do not follow each other")
                with fs.open_input_stream(posixpath.join(path, f"{name}.ids"), compression=None) as stream:
                    for a, b in document_slices(ends, READ):
                        ids = np.frombuffer(stream.read(int(ends[b] - ends[a])), shard.dtype).astype("<u4")
                        at = ((ends[a : b + 1] - ends[a]) // shard.dtype.itemsize).tolist()
                        crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                        yield batch_of(RECORDS, pa.array(keys[a:b], mask=~valid[a:b]), base + first[a:b], sizes[a:b], crc)

    return spread(spark, rows, "shard long, name string, base long").mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    folder = run_dir(spark, "tokens")
    return read_token_shards(spark, folder, write_token_shards(docs, tokenizer_path or tokenizer_file(), folder))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, documents(spark, sf_dir))
