"""Sharded WARC archives: a deterministic writer, and a streaming reader.

Records are dealt by range of (key, hash of the payload) and sorted within each
part. The bounds are quantiles of pairs chosen by their own hash, so they follow
from the rows alone: the same rows give the same files, byte for byte, however the
table lies and whatever the cluster. How many parts there are follows from the
number of rows. A key that many rows share, or a null key, is spread over parts by
its payloads. Each part is written as files that roll over at a compressed size;
every record is a gzip member of its own, with headers made anew from the row
alone: the record id is a name-based UUID, the date is a parameter, gzip carries no
time. Files appear by rename when whole; the manifest, written last, commits them.

Of records with equal payloads, the one with the largest key is the response
and the others revisit it, from ``min_payload`` bytes on. Which that is comes
from one aggregation by digest; the rows that revisit travel to the range sort
beside their pages, so payloads are shuffled once.

Nulls: a null payload is empty, a null URL is the empty URL, a null key sorts
first and counts as smaller than any key. Where rows share payload and key, the
first by URL is the response and the rest revisit it. A URL that can't stand in a
header as it is (white space at its ends or in it) is kept beside it in full, as
JSON. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import TempFile, opened, read_manifest, write_manifest
from .shared import partitions

FILE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
UNPACKED_AT_ONCE = 16 << 10  # compressed bytes; what is left of them after a record is copied
PART_ROWS = 4096  # rows of a part, about
SAMPLED = 64  # pairs for each part that tell its bounds
MANY = 1 << 18


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(key: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, which say how long the payload is, and leaves the payload out."""
    digest = b32(sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest + ('-revisit' if revisit else ''))}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(clean := ' '.join(url.split()))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
    ]
    if clean != url:
        lines.append(f"X-Record-URL: {json.dumps(url)}")
    if key is not None:
        lines.append(f"X-Record-Key: {key}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Key: {refers_to}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Roller:
    """Writes a part's records into files of about ``file_bytes`` compressed bytes."""

    def __init__(self, folder: str, part: int, file_bytes: int, level: int) -> None:
        self.folder, self.part, self.file_bytes, self.level = folder, part, file_bytes, level
        self.files: list[dict] = []
        self.out: TempFile | None = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.out, self.records, self.digest = TempFile(self.folder, f"part-{self.part:06d}-{len(self.files):05d}.warc.gz"), 0, hashlib.sha256()
            info = f"software: weftline\r\nformat: WARC File Format 1.1\r\npart: {self.part}\r\nfile: {len(self.files)}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.part}/{len(self.files)}')}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
            self._put(head + info + b"\r\n\r\n")
        self._put(data)
        self.records += 1
        if self.out.size >= self.file_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        packed = member(data, self.level)
        self.digest.update(packed)
        self.out.write(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.commit()
            self.files.append({"part": self.part, "nth": len(self.files), "path": self.out.uri, "bytes": self.out.size, "records": self.records, "sha256": self.digest.hexdigest()})
            self.out = None


MANIFEST = "part int, nth int, path string, bytes long, records long, sha256 string"


def responses(pages: DataFrame, min_payload: int) -> DataFrame:
    """(key, hash, digest, refers_to) of the rows that revisit another key's response; one aggregation by digest, payloads stay behind.

    A digest may have a third of all rows: its rows are counted before the shuffle, and the join back is
    between narrow rows, whose large parts adaptive execution splits.
    """
    narrow = pages.where(F.octet_length("payload") >= min_payload).select("key", "hash", F.unhex(F.sha1("payload")).alias("digest"))
    # Also a key's only rows matter where the key itself repeats, which the writer sees for itself.
    chosen = narrow.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return narrow.join(chosen, "digest").where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "hash", "digest", "refers_to").distinct()


def bounds(pages: DataFrame, parts: int, rows: int) -> np.ndarray:
    """Ascending pairs (key, hash) that part the rows about evenly: quantiles of those pairs whose own hash is least.

    A function of the table alone. The sample has ``SAMPLED`` pairs for each part, for many parts ``MANY`` in all or four for each.
    Pairs that repeat count once.
    """
    if parts < 2:
        return np.zeros((0, 2), np.int64)
    share = min(SAMPLED * parts, max(MANY, 4 * parts)) / rows
    some = pages.select(F.coalesce("key", F.lit(-(2**63))).alias("key"), "hash").where(F.pmod(F.xxhash64(F.lit("part"), "key", "hash"), F.lit(1 << 40)) < int(share * (1 << 40)))
    got = some.distinct().toArrow()
    pairs = np.stack([np.asarray(got["key"]).astype(np.int64), np.asarray(got["hash"]).astype(np.int64)], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.arange(1, parts) * len(pairs) // parts] if len(pairs) else pairs


def part_of(edges: np.ndarray) -> Column:
    """The number of a row's part: how many bounds its pair isn't below."""
    keys, hashes = np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1])
    pair = np.dtype([("key", "<i8"), ("hash", "<i8")])
    held = np.rec.fromarrays([keys, hashes], dtype=pair)

    @F.arrow_udf("int")
    def number(key: pa.Array, hash_: pa.Array) -> pa.Array:
        asked = np.rec.fromarrays([np.asarray(key).astype(np.int64), np.asarray(hash_).astype(np.int64)], dtype=pair)
        return pa.array(np.searchsorted(held, asked, "right").astype(np.int32))

    return number(F.coalesce("key", F.lit(-(2**63))), "hash")


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE, level: int = 6, part_rows: int = PART_ROWS) -> list[dict]:
    """Writes a record per row and returns the manifest's rows (a few per GB)."""
    pages = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("hash", F.xxhash64("payload"))
    other = responses(pages, min_payload)
    both = pages.select("key", "hash", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(other.select("key", "hash", F.lit(0).alias("kind"), F.lit("").alias("url"), F.col("digest").alias("payload"), "refers_to"))
    size = df.count()
    parts = max(1, -(-size // part_rows))
    edges = bounds(pages, parts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, refers, seen = None, object(), {}, set()
        for batch in batches:
            numbers, keys, kinds, urls, payloads, to = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "url", "payload", "refers_to"))
            for n, k, kind, u, p, r in zip(numbers, keys, kinds, urls, payloads, to, strict=True):
                if out is None or n != out.part:
                    if out is not None:
                        out.close()
                        yield told(out)
                    out, at = Roller(folder, n, file_bytes, level), object()
                if k != at:
                    at, refers, seen = k, {}, set()
                if not kind:
                    refers[p] = r
                    continue
                sha1 = hashlib.sha1(p).digest()
                target = refers.get(sha1, k if sha1 in seen else object) if len(p) >= min_payload else object
                seen.add(sha1)
                out.add(record(k, u, p, sha1, None if target is object else target, target is not object, date))
        if out is not None:
            out.close()
            yield told(out)

    def told(out: Roller) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out.files, pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    # A key's rows of one payload share a pair and so a part; of each pair the references come first.
    dealt = both.withColumn("part", part_of(edges) if len(edges) else F.lit(0)).repartitionById(parts, "part")
    dealt = dealt.sortWithinPartitions("part", F.col("key").asc_nulls_first(), "hash", "kind", "url", "payload")
    rows = sorted((r.asDict() for r in dealt.mapInArrow(run, MANIFEST).collect()), key=lambda r: (r["part"], r["nth"]))
    write_manifest(folder, rows, "warc")
    return rows


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a compressed archive's records, one at a time."""
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        unpack, held, pending = zlib.decompressobj(31), [], b""
        while data := f.read(READ_BYTES):
            for at in range(0, len(data), UNPACKED_AT_ONCE):
                pending = data[at : at + UNPACKED_AT_ONCE]
                while pending:
                    held.append(unpack.decompress(pending))
                    pending = b""
                    if unpack.eof:
                        pending = unpack.unused_data
                        yield parsed(b"".join(held))
                        unpack, held = zlib.decompressobj(31), []
        if any(held):
            raise ValueError(f"{uri} ends within a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if (told := headers.get("warc-block-digest")) and told != f"sha1:{b32(hashlib.sha1(block).digest())}":
        raise ValueError("a record's digest is wrong")
    return headers, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the archives that the manifest names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    files = [(r["path"],) for r in read_manifest(folder)]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    sql = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if not files:
        return spark.createDataFrame([], sql)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, block in records(path):
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    revisit = h["warc-type"] == "revisit"
                    if not revisit and (len(body) != length or b32(hashlib.sha1(body).digest()) != digest):
                        raise ValueError(f"{path}: a payload's length or digest is wrong")
                    rows.append((int(h["x-record-key"]) if "x-record-key" in h else None, json.loads(h["x-record-url"]) if "x-record-url" in h else h.get("warc-target-uri"), length, digest, h["warc-type"], int(h["x-refers-to-key"]) if "x-refers-to-key" in h else None, None if revisit else body))
                    size += len(body)
                    if size >= READ_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.createDataFrame(files, "path string").repartition(min(len(files), 4 * partitions(spark))).mapInArrow(run, sql)
