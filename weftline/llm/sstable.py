"""Sorted-string-table shards of token ids.

Documents lie in ascending key order in range-sorted shards. A shard is

    magic | blocks | Bloom filter | index | footer

A block holds entries (shared key bytes, new key bytes, value bytes, the new
part of the key, the value) up to a target size and begins with a whole key.
The sparse index has each block's first key, offset and length; the fixed-size
footer says where filter and index lie. A lookup asks the filter, bisects the
index and scans one block.

Keys: null ids first, then integers in order, then a counter for rows that
repeat an id. Null and empty texts hold the end id alone. An empty table gives
no shard. Shards appear under their names only when whole, and the manifest
names them; a lost executor's task is run again and writes the same bytes.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkStore, runs_between_breaks
from .files import TempFile, opened, read_manifest, write_manifest
from .shared import bounded_slices, partitions, raw_text

MAGIC = b"WFSSTB01"
FOOTER = struct.Struct("<QQQQQQ8s")  # filter offset, filter bytes, index offset, index bytes, entries, tokens, magic
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BLOOM_BITS = 10  # a key
BLOOM_HASHES = 7
MARKS = list(".,!?:;")
SLICE_BYTES = 2 << 20


def key_prefix(key: int | None) -> bytes:
    return b"\x00" if key is None else b"\x01" + (key + (1 << 63)).to_bytes(8, "big")


def key_bytes(key: int | None, part: int, repeat: int) -> bytes:
    """A row's own key: its id, then the part that it lies in where other parts may hold rows of the id before it, then its number."""
    return key_prefix(key) + part.to_bytes(4, "big") + repeat.to_bytes(4, "big")


def key_of(held: bytes) -> int | None:
    return None if held[0] == 0 else int.from_bytes(held[1:9], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(held: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = held[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(id_part: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(id_part)
    step = (h >> 32 | h << 32) & (1 << 64) - 1 | 1
    return [(h + i * step) % (1 << 64) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, folder: str, name: str) -> None:
        self.file = TempFile(folder, name)
        self.file.write(MAGIC)
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[bytes] = []
        self.entries = self.tokens = 0
        self.low = self.high = b""

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if self.entries and key <= self.high:
            raise ValueError("keys must ascend")
        if not self.block:
            shared, self.first = 0, key
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.low = self.low or key
        self.last = self.high = key
        self.ids.append(key[:-8])
        self.entries += 1
        self.tokens += tokens
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.file.size, len(self.block)))
            self.file.write(bytes(self.block))
            self.block.clear()

    def close(self) -> dict:
        self.flush()
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for x in self.ids:
            for place in bloom_places(x, bits):
                bloom[place >> 3] |= 1 << (place & 7)
        bloom_at = self.file.size
        self.file.write(struct.pack("<Q", bits) + bytes(bloom))
        index_at = self.file.size
        self.file.write(b"".join(struct.pack("<HQI", len(k), at, n) + k for k, at, n in self.index))
        index_end = self.file.size
        self.file.write(FOOTER.pack(bloom_at, index_at - bloom_at, index_at, index_end - index_at, self.entries, self.tokens, MAGIC))
        self.file.commit()
        return {"path": self.file.uri, "bytes": self.file.size, "entries": self.entries, "tokens": self.tokens, "low": self.low.hex(), "high": self.high.hex()}


class ShardReader:
    """Reads one shard: ``get`` by binary search, ``items`` in key order. Holds the index, the filter and one block."""

    def __init__(self, uri: str) -> None:
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        bloom_at, bloom_n, index_at, index_n, self.entries, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        held = self.file.read_at(bloom_n, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", held)[0], held[8:]
        held, at, self.index = self.file.read_at(index_n, index_at), 0, []
        while at < len(held):
            n, offset, length = struct.unpack_from("<HQI", held, at)
            at += 14
            self.index.append((held[at : at + n], offset, length))
            at += n
        self.firsts = [x[0] for x in self.index]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[i]
        held, at, key = self.file.read_at(length, offset), 0, b""
        while at < length:
            shared, at = read_varint(held, at)
            fresh, at = read_varint(held, at)
            size, at = read_varint(held, at)
            key = key[:shared] + held[at : at + fresh]
            at += fresh
            yield key, held[at : at + size]
            at += size

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        """The ids under a key, or None. ``repeat`` picks among the shard's rows of one id."""
        want = key_prefix(key)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(want, self.bits)):
            return None
        for i in range(max(0, bisect_right(self.firsts, want) - 1), len(self.index)):
            for k, v in self._block(i):
                if k[:-8] == want:
                    if not repeat:
                        return unpack(v)
                    repeat -= 1
                elif k > want:
                    return None
        return None


def pack(ids: bytes, wide: bool) -> bytes:
    return (b"\x04" if wide else b"\x02") + ids


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct run between spaces and line ends once while it is kept.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its runs on end. A run of
    letters is one word for the tokenizer, and a closing mark another; so many distinct lower-case words are encoded
    as one text, and the ids that end a word tell them apart. All other runs are encoded one by one.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.bare = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        self.bare.normalizer = None  # its three steps are done on the joined runs at once
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.wide = max(vocab.values()) > 65535
        self.kind = "<u4" if self.wide else "<u2"
        told = json.loads(spec)
        mark = told["model"].get("end_of_word_suffix")
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        self.joins = bool(mark) and steps == ["NFC", "Replace", "Lowercase"]
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        if self.joins:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.store = ChunkStore(self.learn, self.kind)

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of each chunk, as bytes."""
        known: dict[str, bytes] = {}
        cores, rest = {}, []
        for c in fresh:
            core = c if c.isalpha() else c[:-1]
            # Lower-casing these two depends on what is around them, or makes a mark that is no letter.
            if not self.joins or not core.isalpha() or core is not c and c[-1] not in MARKS or "\u03a3" in c or "\u0130" in c:
                rest.append(c)
            else:
                cores[c] = core.lower() if core.isascii() else unicodedata.normalize("NFC", core).lower()
        rest += self._joined([*{*cores.values()}], known)
        rest += MARKS
        for at in range(0, len(rest), 50_000):
            some = rest[at : at + 50_000]
            got = self.tok.encode_batch_fast(some, add_special_tokens=False)
            known.update(zip(some, (np.asarray(e.ids, self.kind).tobytes() for e in got), strict=True))
        for c, core in cores.items():
            known[c] = known[core] if c[-1] not in MARKS else known[core] + known[c[-1]]
        return [known[c] for c in fresh]

    def _joined(self, cores: list[str], known: dict[str, bytes]) -> list[str]:
        """Encodes single words in long texts; returns those that must go one by one."""
        size, left, texts = 4 if self.wide else 2, [], [cores[at : at + 200] for at in range(0, len(cores), 200)]
        for at in range(0, len(texts), 100):
            many = texts[at : at + 100]
            for some, got in zip(many, self.bare.encode_batch_fast([" ".join(x) for x in many], add_special_tokens=False), strict=True):
                ids = np.asarray(got.ids, self.kind)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(some) or ends[-1] != len(ids):
                    left += some
                    continue
                held, cuts = ids.tobytes(), [0, *(ends * size).tolist()]
                known.update(zip(some, (held[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        return left

    def encode_batch(self, column: pa.Array) -> list[bytes]:
        raw, at = raw_text(column)
        flat, sizes = self.store.ids(raw, at, *runs_between_breaks(raw, at))
        held, cuts = flat.tobytes(), (np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize).tolist()
        return [held[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODER: dict[int, ChunkEncoder] = {}


def chunk_encoder(spec: str) -> ChunkEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = ChunkEncoder(spec)
    return _ENCODER[key]


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encodes every whole text, appends ``end_id`` and writes shards in ascending key order; returns the manifest's rows.

    One shuffle: the texts are dealt by ranges of key and text's hash and sorted within each part, so rows that share a key, however
    many, are spread over parts. Rows of one key are in the order of that hash and then of their texts. Each row of the manifest says how many tokens
    lie before its shard (``start``), which takes one pass over the shards' counts, never over documents.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, before, first, repeat = TaskContext.get().partitionId(), [], None, None, None, 0
        enc = None
        for batch in batches:
            enc = enc or chunk_encoder(spec.value)
            end = np.asarray([end_id], enc.kind).tobytes()
            for piece in bounded_slices(batch, "text", SLICE_BYTES):
                for k, ids in zip(piece.column("key").to_pylist(), enc.encode_batch(piece.column("text")), strict=True):
                    own = key_prefix(k)
                    repeat = repeat + 1 if own == before else 0
                    before, first = own, first or own
                    if out is None:
                        out = ShardWriter(folder, f"shard-{part:06d}-{len(files):05d}.sst")
                    out.add(key_bytes(k, part if own == first else 0, repeat), pack(ids + end, enc.wide), len(ids) // (4 if enc.wide else 2) + 1)
                    if out.file.size >= shard_bytes:
                        files.append(out.close())
                        out = None
        if out is not None:
            files.append(out.close())
        if files:
            yield pa.RecordBatch.from_pylist([x | {"part": part, "nth": i} for i, x in enumerate(files)], pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64()), ("low", pa.string()), ("high", pa.string())]))

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("hash"), F.col("text").asc_nulls_first()]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions(df.sparkSession), *order[:2]).sortWithinPartitions(*order).select("key", "text")
    told = dealt.mapInArrow(run, "part int, nth int, path string, bytes long, entries long, tokens long, low string, high string").collect()
    rows, start = [], 0
    for r in sorted(told, key=lambda r: r["low"]):
        rows.append(r.asDict() | {"start": start})
        start += r["tokens"]
    write_manifest(folder, rows, "token shards")
    return rows


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the shards that the manifest names: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = [(r["path"], r["start"]) for r in read_manifest(folder)]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = r["start"], []
                for k, v in ShardReader(r["path"]).items():
                    ids = unpack(v)
                    rows.append((key_of(k), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _found(rows)
                        rows = []
                yield _found(rows)

    return spark.createDataFrame(files, "path string, start long").repartition(min(len(files), 4 * partitions(spark))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(folder: str, key: int | None) -> np.ndarray | None:
    """Ids of one document, by binary search over the manifest's key ranges and then within a shard."""
    rows = read_manifest(folder)
    i = bisect_left([r["high"] for r in rows], key_prefix(key).hex())
    return ShardReader(rows[i]["path"]).get(key) if i < len(rows) else None
