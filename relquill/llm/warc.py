"""Operator 8, WARC archives as chunked record tables.

Writing: pages are hashed in the JVM, the smallest page of each payload digest is
found by a pre-aggregated group, and each task streams its records into one
gzip-per-record archive in the shared folder. Reading: archives are streamed and
every record becomes rows (record, chunk number, bytes) of at most ``chunk`` bytes
that carry the running length and digest, so no record is ever held whole; the
digest of a record's last row is that of its payload.

Revisits carry the digest and length of the payload they repeat, and the record that has it.
Ties cannot arise: a payload's response is that of its least page. Very long pages are
streamed in chunks. Of repeated rows
(same page, same payload) one is the response. Null html: empty. Null page_id:
written without a page, a response only if no page with an id has its payload.
Null or odd url: written as empty, line ends stripped. Extra columns are ignored.
Empty table: no archives, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm.common import ShardFile, batch_of, column, filesystem, join_hot, materialize, partition_id, run_dir, spread

CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("records", pa.int64())])
CHUNKS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
CHUNKS_DDL = "record_id string, page_id long, record_type string, refers_to long, url string, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: int | None, digest: str, which: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{which}')}>"


def decide(pages: DataFrame, least: int) -> DataFrame:
    """Each page with its payload's digest and, for a revisit, the page it repeats."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = F.col("page_id").cast("long").alias("page_id")
    # the page and its payload as one key, never null
    key = F.concat_ws("/", F.col("page_id").cast("string"), "digest").alias("key")
    rows = pages.select(page, F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    # digests are stored for the groups, pages are not
    narrow = pages.select(page, F.sha1(html).alias("digest"), (F.octet_length(html) >= least).alias("big")).filter("big")
    narrow = materialize(narrow.drop("big"), "digests")
    first = materialize(narrow.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).filter("copies > 1"), "first-pages")
    repeated = join_hot(narrow, first, ("digest",), "copies").select(key, "first_page").groupBy("key").agg(F.first("first_page").alias("first_page"), F.lit(True).alias("repeated"))
    # pages move once, by a key that the join and the writer share
    joined = rows.select("*", key).repartition(F.col("key")).join(repeated, "key", "left")
    return joined.select("key", "page_id", "url", "html", "digest", F.coalesce("repeated", F.lit(False)).alias("repeated"), "first_page")


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> list:
    """Archives of ``pages`` (page_id, url, html) below ``folder``; the list of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, n = partition_id(), None, 0
        last, name = None, f"pages-{shard:07d}.warc.gz"
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("page_id", "url", "digest", "repeated", "first_page")]
            html = column(batch, "html").cast(pa.binary())
            for i, (page, url, digest, repeated, first) in enumerate(zip(*cols, strict=True)):
                if out is None:
                    out = ShardFile(folder, name)
                revisit = repeated and (page != first or (page, digest) == last)
                last = (page, digest)
                payload = html[i].as_buffer()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                http += b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % payload.size
                # the response that others repeat has a name that they can tell
                record = record_id(page, digest, "first" if repeated and not revisit else f"{shard}/{n}")
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join(url.split())), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(digest))), ("X-Payload-Length", payload.size)]
                if page is not None:
                    fields.append(("X-Page-ID", page))
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest, "first"))]
                    if first is not None:
                        fields.append(("X-Refers-To-Page-ID", first))
                fields.append(("Content-Length", len(http) + (0 if revisit else payload.size)))
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                out.write(member.compress(header(fields) + http))
                if not revisit:
                    for at in range(0, payload.size, CHUNK):
                        out.write(member.compress(payload.slice(at, min(CHUNK, payload.size - at))))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n += 1
        if out is not None:
            out.close()
            yield batch_of(WRITTEN, [shard], [name], [n])

    # equal rows side by side: the first of a run is the response
    rows = decide(pages, least).sortWithinPartitions("key").drop("key")
    written = rows.mapInArrow(run, "shard long, name string, records long")
    return sorted(written.collect(), key=lambda r: r["shard"])  # a row for each archive


class Inflated:
    """A buffered reader over the gzip members of an archive."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.member, self.over = stream, b"", b"", zlib.decompressobj(31), False

    def fill(self) -> bool:
        while not self.over:
            if self.member.eof:
                self.raw = self.member.unused_data + self.raw
                self.member = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    self.over = True
                    return False
            got = self.member.decompress(self.raw, CHUNK)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.out.find(mark)) < 0:
            if not self.fill():
                return None
        got, self.out = self.out[:k], self.out[k + len(mark) :]
        return got

    def some(self, most: int) -> bytes:
        if not self.out and not self.fill():
            raise EOFError("the archive ends within a record")
        got, self.out = self.out[:most], self.out[most:]
        return got

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.some(n))
            n -= len(parts[-1])
        return b"".join(parts)


def fields_of(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def record_chunks(stream, chunk: int = CHUNK, data: bool = True) -> Iterator[tuple]:
    """Rows of CHUNKS for each record; ``data`` False leaves the bytes out, not the digests."""
    src = Inflated(stream)
    while (block := src.until(b"\r\n\r\n")) is not None:
        f = fields_of(block)
        whole = int(f["content-length"])
        http = src.until(b"\r\n\r\n")
        left = whole - len(http) - 4
        page = int(f["x-page-id"]) if "x-page-id" in f else None
        refers = int(f["x-refers-to-page-id"]) if "x-refers-to-page-id" in f else None
        key = (f["warc-record-id"], page, f["warc-type"], refers, f["warc-target-uri"])
        if f["warc-type"] == "revisit":
            yield (*key, 0, None, int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), True)
        else:
            digest, k, seen = hashlib.sha1(), 0, 0
            while left or not k:
                got = src.exactly(min(chunk, left))
                digest.update(got)
                left -= len(got)
                seen += len(got)
                yield (*key, k, got if data else None, seen, base32(digest.copy().digest()), not left)
                k += 1
            if base32(digest.digest()) != f["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"{key[0]}: the payload differs from its digest")
        src.exactly(4)


def read_warc(spark: SparkSession, folder: str, archives: list, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in column(batch, "name").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for row in record_chunks(stream, chunk, data):
                        rows.append(row)
                        held += 200 + len(row[6] or b"")
                        if held > 8 * CHUNK:
                            yield batch_of(CHUNKS, *zip(*rows, strict=True))
                            rows, held = [], 0
                if rows:
                    yield batch_of(CHUNKS, *zip(*rows, strict=True))

    return spread(spark, [(r["shard"], r["name"]) for r in archives], "shard long, name string").mapInArrow(run, CHUNKS_DDL)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    rows = read_warc(spark, folder, archives, data=False).filter("last")
    return rows.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
