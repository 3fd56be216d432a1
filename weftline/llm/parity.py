"""Near-duplicate join by parity sketches of word shingles.

A text's set of 5-word shingles is XOR-hashed into a sketch of bits: each
shingle flips one bit, so two sketches differ in at most as many bits as the
sets differ in elements. Sets of sizes a and b whose Jaccard similarity is at
least 4/5 differ in at most (a + b) / 9 elements. The sketch of a size band is
cut into K blocks; a pair that differs in at most t bits agrees on K - t of
them at least. So each set need only show t + 1 blocks, in one order that all
sets share, and any linked pair still shows a block in common. Any order will
do; the one used puts rare blocks first: those that hold a shingle that isn't
common, then the fullest. Which shingles are common is told from every 32nd set,
which bears on the order alone. Nothing is capped and no set is left out: the
join loses no link. Sets near a band's upper edge also show their blocks in the
next band.

Small bands are cut into more blocks, so that a set practically always
fills as many as it must show (the chance of the contrary is below one in a
billion) and no block is shared for its emptiness; where a set fills fewer, it
shows empty ones, so no link is lost then either.

Blocks are packed by bucket in binary rows, so the shuffle carries about seven
bytes a block and the grouping is a sort of integers in each bucket. Buckets grow
in number with the corpus, and a task holds one at a time.

Equal sets are one node from the start, whatever the number of their copies.
Candidates whose whole sketches differ too much are dropped; the rest are
verified on the exact sets. Nodes that are known to be connected need no further
pair, so this is done in steps, and a large group never becomes all its pairs:
first every node is held against the least node of a block, then against a few
nodes of other components that share a block with it, the same for all nodes of
a block. What is left between different components is then compared in full, by
sketches within the blocks, in some blocks first and then in all, so components
are exact.

Defined results: null and empty texts, and texts of white space alone, have no
shingle and are linked with nothing; a text of fewer than five words has one
shingle, its whole sequence. Rows with a null id are kept, with a null
component, and linked with nothing. Repeated rows fall into one component.
Empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_slices, materialize, partitions, release
from .words import U, mix, shingle_sets, words_of

SLICE_BYTES = 1 << 20
PLACES = 46  # a sketch whose blocks are joined has 2^46 bits, of which a set's blocks hold those that are 1
SLACK = 2  # blocks of a band for each that a set must show
SKETCH_BITS = 1024  # at least
TILE = 4096  # nodes of a block that one task compares with as many
SAMPLE = 32  # one set in so many tells which shingles are common
COMMON_BITS = 22
MOST_COMMON = 500_000
AT_ONCE = 500_000  # blocks that a task packs at once, and 32 for each bucket at least
BUCKET = 1 << 20  # blocks of a bucket, about
BUCKETS = 1 << 24  # at most, as a block's upper bits tell its bucket
MOST_AT_ONCE = 1 << 22
PROPOSED = 3  # rounds in which nodes are held against a few others
WAVE = 16  # one block in so many is compared in full before all are
EACH = 3  # pairs of a node in a round
LIGHT = 100_000  # rows of a few numbers for each task of a round's shuffles, at least
HEAVY = 8 << 20  # bytes of elements
KEY = "key long, n_shingles long, sid long"


def set_id(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set, the same for equal sets."""
    return int((mix(elements).sum(dtype=U) ^ U(len(elements))).view(np.int64))


def blocks_of(band: int) -> int:
    """Blocks of a band: twice what its sets must show, and for small bands so many that sets fill what they must show.

    A set of 4 must show 2 of 1024, one of 8 must show 3 of 256, one of 16 must show 5 of 64: the chance that all its
    elements fall into fewer is below 1e-9.
    """
    most = (2 * (2 ** (band + 1) - 1)) // 9
    return max(SLACK * (most + 1), 1 << max(0, 14 - 2 * band))


def sketch(elements: np.ndarray) -> bytes:
    """Parity sketch for the filter: one bit flipped by each element, in four to eight bits an element."""
    bits = max(SKETCH_BITS, 4 << len(elements).bit_length())
    return np.packbits(np.bincount((mix(elements ^ U(5)) & U(bits - 1)).view(np.int64), minlength=bits) % 2 == 1, bitorder="little").tobytes()


def short_sketch(blob: bytes) -> bytes:
    """Half of a sketch's bits, within bounds, for comparing many at once."""
    return folded(blob, min(max(len(blob) // 2, 128), 512)).tobytes()


def folded(blob: bytes, size: int) -> np.ndarray:
    """A sketch brought down to ``size`` bytes; parities of halves add up."""
    out = np.frombuffer(blob, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """A table by the shingles' upper bits of those that lie in many sets; the most common ``MOST_COMMON`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [s for part in bounded_slices(batch, "text", SLICE_BYTES) for s in shingle_sets(words_of(part.column("text"))) if len(s) and set_id(s) % SAMPLE == 0]
            value, n = np.unique(np.concatenate([*held, np.zeros(0, U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["shingle", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.where("n >= 3").orderBy(F.col("n").desc(), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    out = np.zeros(1 << COMMON_BITS, bool)
    out[(np.asarray(rows["shingle"]).astype(np.int64).view(U) >> U(64 - COMMON_BITS)).view(np.int64)] = True
    return out


def shown(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sets and the blocks that each shows, as 64-bit hashes that include band and block."""
    owners, found = [], []
    for reach in (False, True):
        some = []
        for i, s in enumerate(sets):
            n = len(s)
            if not n:
                continue
            band, widest = n.bit_length() - 1, n * 5 // 4
            if reach and widest.bit_length() - 1 == band:
                continue
            band += reach
            some.append((i, band, (n + min(widest, 2 ** (band + 1) - 1)) // 9 + 1))
        if not some:
            continue
        lengths = np.array([len(sets[i]) for i, _, _ in some])
        node = np.repeat(np.arange(len(some)), lengths)
        bands = np.array([b for _, b, _ in some])
        count = np.array([blocks_of(b) for b in range(int(bands.max()) + 1)], U)[bands]
        elements = np.concatenate([sets[i] for i, _, _ in some])
        rare = ~common[(elements >> U(64 - COMMON_BITS)).view(np.int64)]
        places = elements >> U(64 - PLACES)
        # Bits that are flipped an even number of times are as they were.
        begins = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (node[1:] != node[:-1])]))
        odd = begins[np.diff(begins, append=len(places)) % 2 == 1]
        places, node, rare = places[odd], node[odd], rare[odd]
        block = ((places >> U(PLACES - 32)) * count[node]) >> U(32)
        begins = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (node[1:] != node[:-1])])) if len(places) else np.zeros(0, np.int64)
        salt = mix(bands.astype(U) + U(77))
        content = mix(np.bitwise_xor.reduceat(mix(places ^ salt[node]), begins)) if len(begins) else np.zeros(0, U)
        full = np.diff(begins, append=len(places))
        first = np.logical_or.reduceat(rare, begins) if len(begins) else np.zeros(0, bool)
        order = (np.where(first, 127 - np.minimum(full, 127), 255 - np.minimum(full, 127)).astype(U) << U(56)) | (content >> U(8))
        cut = np.searchsorted(node[begins], np.arange(len(some) + 1))
        for k, (i, band, take) in enumerate(some):
            a, b = cut[k], cut[k + 1]
            mine = content[a:b]
            if b - a > take:
                mine = mine[np.argpartition(order[a:b], take - 1)[:take]]
            elif b - a < take:
                empty = np.setdiff1d(np.arange(int(count[k]), dtype=U), block[begins[a:b]])
                empty = np.sort(mix(mix(empty + U(1 << 40)) ^ salt[k]))
                mine = np.concatenate([mine, empty[: take - (b - a)]])
            owners.append(np.full(len(mine), i))
            found.append(mine)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(owners), np.concatenate(found)


def packed(owner: np.ndarray, blocks: np.ndarray) -> bytes:
    """Owners' names, how many blocks each has, and six bytes of each block; sorted by owner."""
    order = np.argsort(owner, kind="stable")
    names, counts = np.unique(owner, return_counts=True)
    low = blocks[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return len(names).to_bytes(4, "little") + names.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + low.tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    names, counts = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)
    low = np.frombuffer(blob, np.uint8, offset=4 + 12 * n).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    return np.repeat(names, counts), wide.view("<u8").ravel()


def shingle_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles and sid (0 shingles: null) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(words_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], ["key", "n_shingles", "sid"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, KEY)


def block_groups(docs: DataFrame, key: str, text: str, expected: int = 0) -> DataFrame:
    """(block, sid, least): for each block that two or more sets show, its sets, and the least of them.

    ``expected`` is about how many blocks are shown, by which the number of buckets and tasks grows.
    """
    buckets = min(BUCKETS, max(4 * partitions(docs.sparkSession), expected // BUCKET))
    tasks = max(partitions(docs.sparkSession), buckets // 4)
    at_once = min(max(AT_ONCE, 32 * buckets), MOST_AT_ONCE)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(common_shingles(docs, text)))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(sent.value).astype(bool)

        def dealt(names: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
            names, blocks = np.concatenate([*names, np.zeros(0, np.int64)]), np.concatenate([*blocks, np.zeros(0, U)])
            bucket = (blocks >> U(40)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            some, at = np.unique(bucket[order], return_index=True)
            rows = [(i, packed(names[o], blocks[o])) for i, o in zip(some.tolist(), np.split(order, at[1:]), strict=True) if len(o)] if len(order) else []
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "packed"])

        names, blocks, had, size = [], [], set(), 0
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                sets = []
                for s in shingle_sets(words_of(part.column("text"))):
                    name = set_id(s) if len(s) else None
                    if name is not None and name not in had:
                        had.add(name)
                        sets.append((name, s))
                owner, found = shown([s for _, s in sets], common)
                names.append(np.array([n for n, _ in sets], np.int64)[owner])
                blocks.append(found)
                size += len(found)
                if size > at_once:
                    yield dealt(names, blocks)
                    names, blocks, had, size = [], [], set(), 0
        yield dealt(names, blocks)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    yield from grouped(at, held)
                    at, held = bucket, []
                held.append(unpacked(blob))
        yield from grouped(at, held)

    def grouped(bucket: int | None, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        names, blocks = np.concatenate([n for n, _ in held]), np.concatenate([b for _, b in held])
        blocks = mix(blocks ^ mix(np.full(1, bucket, U)))  # a block's name beyond its bucket
        order = np.lexsort((names, blocks))
        names, blocks = names[order], blocks[order]
        fresh = np.ones(len(names), bool)
        fresh[1:] = (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])
        names, blocks = names[fresh], blocks[fresh]
        begins = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else np.zeros(0, np.int64)
        sizes = np.diff(begins, append=len(blocks))
        keep = np.repeat(sizes > 1, sizes)
        least = np.repeat(names[begins], sizes)[keep]
        names, blocks = names[keep], blocks[keep].view(np.int64)
        for at in range(0, len(names), 65536):
            to = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[to]), pa.array(names[to]), pa.array(least[to])], ["block", "sid", "least"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.mapInArrow(show, "bucket int, packed binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(group, "block long, sid long, least long")


def exact_sets(docs: DataFrame, keys: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(sid, n, sketch, short, elements) of the wanted sets, from one document of each."""
    one = keys.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key")).select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                sets = [s for s in shingle_sets(words_of(part.column("text"))) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(held := [sketch(s) for s in sets], pa.binary()), pa.array([short_sketch(x) for x in held], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["sid", "n", "sketch", "short", "elements"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(one, "key", "left_semi").select("text")
    return rows.mapInArrow(run, "sid long, n long, sketch binary, short binary, elements binary")


def few(df: DataFrame, light: int, heavy: int = 0) -> DataFrame:
    """``df`` in fewer tasks, where its rows are few for the shuffle's partitions; rounds have many small shuffles."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, light // LIGHT + heavy // HEAVY + 1)
    return df.coalesce(tasks) if tasks < partitions(spark) else df


def linked(pairs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: those whose sketches allow it, by exact intersection.

    ``size`` is about how many bytes the elements of all pairs and sets take.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x_sketch").to_pylist(), batch.column("y_sketch").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                apart[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)
            n, m = (np.asarray(batch.column(c)) for c in ("x_n", "y_n"))
            good = (9 * apart <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    short = sets.select("sid", "n", "sketch")
    for name, side in (("a", "x"), ("b", "y")):
        pairs = few(pairs.join(short.select(F.col("sid").alias(name), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), name), 0, size)
    pairs = pairs.select("a", "b", "x_n", "y_n", "x_sketch", "y_sketch").mapInArrow(near, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = few(pairs.join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), "a"), 0, size)
    held = few(held.join(sets.select(F.col("sid").alias("b"), F.col("elements").alias("y")), "b"), 0, size)
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have edges.

    Labels fall to the least label around, and then jump to their label's label, until nothing changes. ``start``
    holds labels known before, which count as edges.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if start is not None:
        known = start.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        both = both.unionByName(known).unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = both.count()
    both = materialize(few(both.distinct(), n), "edges")
    before = labels = materialize(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), n), "labels")
    while True:
        near = few(both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("c")), "b"), n).groupBy("a").agg(F.min("c").alias("m"))
        fallen = few(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root")), n)
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(few(fallen.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), n), "labels")
        settled = new.where("old <> root").isEmpty()
        release(before)
        before, labels = new, new.select("node", "root")
        if settled:
            release(both)
            return labels


def proposals(held: DataFrame, turn: int, n: int) -> DataFrame:
    """Pairs (a, b) for a round, at most ``EACH`` for each node: in each block all nodes are held against the node that
    comes first in the round's own order, and those of its component against the first node of another one. ``n`` is about
    how many rows there are."""
    firsts = held.groupBy("block", "root").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "sid").alias("at"), "sid")).alias("first"))
    firsts = few(firsts, n)
    best = firsts.groupBy("block").agg(F.min(F.struct("first", "root")).alias("best"))
    second = firsts.join(best, "block").where(F.col("root") != F.col("best.root")).groupBy("block").agg(F.min("best").alias("best"), F.min("first").alias("second"))
    pivot = F.when(F.col("root") == F.col("best.root"), F.col("second")).otherwise(F.col("best.first"))
    some = few(held.join(second, "block").select("sid", pivot.alias("pivot")), n).groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("pivot")), 1, EACH).alias("pivots"))
    pairs = few(some, n).select("sid", F.explode("pivots").alias("pivot")).select(F.greatest("sid", "pivot.sid").alias("a"), F.least("sid", "pivot.sid").alias("b"))
    return pairs.distinct()


def across(held: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes that share a block, lie in different components, and whose sketches allow a link.

    Sketches are compared within each block where they lie; only pairs that pass are given out. A block of more than
    ``TILE`` nodes is dealt out as pairs of tiles, so it is spread over tasks.
    """
    tiles = held.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    rows = held.join(sets.select("sid", "n", F.col("short").alias("sketch")), "sid").join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "sid", "root", "n", "sketch")

    def compared(group: list[dict]) -> list[tuple[int, int]]:
        size = min(len(r["sketch"]) for r in group)
        bits = np.stack([folded(r["sketch"], size) for r in group]).view(U)
        sid, root, n, tile = (np.array([r[c] for r in group], np.int64) for c in ("sid", "root", "n", "tile"))
        apart_tiles, out = group[0]["low"] != group[0]["high"], []
        for i in range(len(group) - 1):
            rest = slice(i + 1, None)
            good = (root[rest] != root[i]) & (5 * np.minimum(n[rest], n[i]) >= 4 * np.maximum(n[rest], n[i]))
            if apart_tiles:
                good &= tile[rest] != tile[i]
            at = np.flatnonzero(good) + i + 1
            if len(at):
                at = at[9 * np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[at] + n[i]]
                out += [(max(int(sid[i]), int(sid[j])), min(int(sid[i]), int(sid[j]))) for j in at]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for r in batch.to_pylist():
                where = (r["block"], r["low"], r["high"])
                if where != at:
                    if len(group) > 1:
                        found.update(compared(group))
                    group, at = [], where
                group.append(r)
            if len(found) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                found = set()
        if len(group) > 1:
            found.update(compared(group))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    keys = ["block", "low", "high"]
    return rows.repartition(partitions(held.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, n_shingles and component_id (the least key that links reach)."""
    keys = materialize(shingle_keys(docs, key, text), "keys")
    shown_blocks = keys.agg(F.sum(F.col("n_shingles") / 4 + 1)).first()[0] or 0
    groups = materialize(block_groups(docs, key, text, int(shown_blocks)), "blocks")
    nodes = groups.select("sid").distinct()
    sets = materialize(exact_sets(docs, keys, nodes, key, text), "sets")

    shared = groups.count()
    told = sets.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.avg("n"), F.lit(0)) * 8).alias("bytes")).first()
    labels, tested, blocks, written, turn = None, None, groups, [], 0
    while True:
        held = groups
        if labels is not None:
            held = few(held.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left"), shared)
        held = held.withColumn("root", F.coalesce("root", "sid") if labels is not None else F.col("sid"))
        if labels is not None:  # blocks within one component are done with
            mixed = held.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block")
            held, done = materialize(few(held.join(mixed, "block", "left_semi"), shared), "blocks"), blocks
            release(done)
            blocks, groups = held, held.drop("root")
            if held.isEmpty():
                break
        if turn == 0:  # against the least node of a block
            pairs = groups.where("sid <> least").groupBy("sid").agg(F.min("least").alias("b")).select(F.col("sid").alias("a"), "b")
        elif turn <= PROPOSED:  # against a few nodes of other components
            pairs = proposals(held, turn, shared)
        elif turn == PROPOSED + 1:  # in full, in some blocks; what is linked there isn't told again by the others
            pairs = across(held.where(F.pmod(F.xxhash64("block"), F.lit(WAVE)) == 0), sets)
        else:
            pairs = across(held, sets)
        pairs = pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs
        pairs = materialize(few(pairs, shared) if turn <= PROPOSED else pairs, "pairs")
        more = materialize(linked(pairs, sets, int((pairs.count() + told["n"]) * told["bytes"])), "links")
        tested = tested.unionByName(pairs) if tested is not None else pairs
        written += [pairs, more]
        if turn == PROPOSED + 2:
            if not more.isEmpty():
                labels = components(more, labels)
            break
        if more.isEmpty() and turn:
            turn = PROPOSED + 2  # what is left is compared in full at once
            continue
        turn += 1
        if not more.isEmpty():
            labels = components(more, labels)
    release(*written, blocks, sets)
    if labels is None:
        labels = keys.sparkSession.createDataFrame([], "node long, root long")

    # The least key of each component, for sets that have copies or links; all other rows stand for themselves.
    least = keys.where("sid is not null and key is not null").groupBy("sid").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    rooted = least.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").where("n > 1 or root is not null").select("sid", F.coalesce("root", "sid").alias("root"), "low")
    chosen = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("sid", "component_id")
    out = keys.join(chosen, "sid", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of the least key stays, with all columns.

    Rows that repeat a kept key and lie in its component stay too (they can't be told apart by key), unless they are equal
    in every column. Rows with a null key stay.
    """
    gone = near_duplicates(docs, key, text).where(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti")
