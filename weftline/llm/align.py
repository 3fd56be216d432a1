"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level BPE (A) encodes a space and the text, a SentencePiece model (B) the
text, before which it puts a space itself. Each token covers a range of bytes.
Tokens of A and B whose ranges overlap are linked: this is a bipartite graph, and
its connected components, found by union-find, are exactly the minimal groups
between two offsets where tokens of both sides end. A component's members expand
its links. Then, over all documents, each pair of ids is counted by the documents
that hold it linked.

Texts are encoded once; what is written of each document is its distinct linked
pairs, four bytes a pair, and how often it has them. Counting is distributed:
tasks reduce the pairs of their documents and a shuffle adds them up. The counts
are brought back to the documents without shuffling links: pairs of the highest
counts, at most ``TABLE`` of them, are sent to all tasks, and what each id of A
has at most is an array as long as its vocabulary. Where the table holds every
pair of two or more documents, others have a count of one; else the links that it
doesn't tell are joined by a shuffle.

Chunks that neither tokenizer merges across (runs that begin with their spaces)
are encoded once and looked up after that. B's pieces never hold a space after
another character; a model that has such pieces is encoded text by text.

Defined results: null and empty texts, and texts whose joined A or B bytes aren't
a space and the text (such as texts with U+2581), have no tokens: all counts are
0 and ``groups_sha256`` is empty. Special tokens' strings are plain text. Repeated
rows are documents of their own. Rows with a null id are kept and counted. Empty
tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TrieBpe, built, share
from .chunks import ChunkStore, spaced_chunks
from .shared import bounded_slices, materialize, raw_text, release
from .unionfind import unite


SLICE_BYTES = 1 << 20
HELD = 2_000_000  # pairs that a task holds before it reduces or gives them out
TABLE = 2_000_000  # pairs whose counts are sent to all tasks
SPACE = "▁"


class Pool:
    """Byte strings by id, for joining many at once."""

    def __init__(self, of: dict[int, bytes]) -> None:
        size = max(of, default=0) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, x in of.items():
            self.lengths[i] = len(x)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(of.get(i, b"") for i in range(size)), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))]


class Pieces:
    """A SentencePiece model's encoder of many texts, by chunks that are looked up."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.pool = Pool({i: bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)})
        self.cuts = not any(SPACE in x.lstrip(SPACE) for x in names)
        self.space = np.array([self.model.piece_to_id(SPACE)], "<u4").tobytes()
        self.store = ChunkStore(self.learn, "<u4")

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that each begin with the space that the model puts before a text; a lone space is its piece."""
        return [self.space if c == " " else np.array(ids, "<u4").tobytes() for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has; each text must begin with a space."""
        starts = at[:-1]
        if self.cuts and len(raw):
            space = raw == 32
            begins = np.zeros(len(raw), bool)
            begins[1:] = space[1:] & ~space[:-1]
            begins[starts] = True
            starts = np.flatnonzero(begins)
        return self.store.ids(raw, at, starts, np.append(starts[1:], len(raw)))


class Aligned(NamedTuple):
    """Links of the texts of a slice that have tokens, in order, and what they hang from."""

    n_a: np.ndarray  # of each text
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: np.ndarray  # of each link
    pair: np.ndarray  # of each link: A's id times B's vocabulary plus B's id
    groups: list[str]


class Aligner:
    def __init__(self, spec: str, model: bytes) -> None:
        self.a: TrieBpe = built(spec)
        self.b = Pieces(model)
        self.pool = Pool(self.a.bytes_of)
        self.wide = len(self.b.pool.lengths)
        # Decimal ids with room for one mark after each.
        most = max(len(self.pool.lengths), self.wide)
        self.digits = Pool({i: b"%d " % i for i in range(most)})

    def __call__(self, column: pa.Array, digests: bool = True) -> Aligned:
        n = len(column)
        held = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) > 0
        raw, at = raw_text(pc.binary_join_element_wise(pa.scalar(" ", column.type), column.filter(pa.array(held)), pa.scalar("", column.type)))
        a, a_sizes = self.a.store.ids(raw, at, *spaced_chunks(raw, at))
        b, b_sizes = self.b.ids(raw, at)
        same = self._same(self.pool, a, a_sizes, raw, at) & self._same(self.b.pool, b, b_sizes, raw, at)
        if not same.all():
            a, b = a[np.repeat(same, a_sizes)], b[np.repeat(same, b_sizes)]
            a_sizes, b_sizes = a_sizes * same, b_sizes * same
        rows = np.flatnonzero(held)
        counts = [np.zeros(n, np.int64) for _ in range(4)]
        counts[0][rows], counts[1][rows] = a_sizes, b_sizes
        # Every stretch between two ends of tokens lies in one token of each side, and is their link.
        a_ends, b_ends = np.cumsum(self.pool.lengths[a]), np.cumsum(self.b.pool.lengths[b])
        side = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
        side[a_ends] = 1
        side[b_ends] |= 2
        side[0] = 0
        side = side[side > 0]
        i, j = (np.cumsum(x) - x for x in (side & 1, side >> 1))  # ends of each side that lie before a stretch's end
        i, j = i.astype(np.int64), j.astype(np.int64)
        parent = np.arange(len(a) + len(b))
        unite(parent, i, len(a) + j)
        text = np.repeat(rows, a_sizes)
        group, inverse = np.unique(parent[: len(a)], return_inverse=True)  # a component's least node is its first token of A
        counts[2] += np.bincount(text[group], minlength=n)
        counts[3] += np.bincount(text[i], minlength=n)
        groups = self._groups(n, a, b, inverse, np.searchsorted(group, parent[len(a) :]), counts[0] + counts[1]) if digests else []
        return Aligned(*counts, text[i], a[i].astype(np.int64) * self.wide + b[j], groups)

    @staticmethod
    def _same(pool: Pool, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts the tokens' bytes give back."""
        joined = pool.joined(ids)
        if len(joined) == len(raw) and np.array_equal(joined, raw):
            return np.ones(len(sizes), bool)
        ends = np.concatenate([[0], np.cumsum(pool.lengths[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.array([np.array_equal(joined[ends[k] : ends[k + 1]], raw[at[k] : at[k + 1]]) for k in range(len(sizes))], bool)

    def _groups(self, n: int, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, sizes: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups: A's ids, a bar, B's ids, with semicolons between groups; '' without tokens."""
        if not len(a):
            return [""] * n
        k = int(a_group[-1]) + 1
        a_before, b_before = np.searchsorted(a_group, np.arange(k + 1)), np.searchsorted(b_group, np.arange(k + 1))
        place_a = np.arange(len(a)) + b_before[a_group]
        place_b = np.arange(len(b)) + a_before[b_group + 1]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a[a_before[1:] - 1]] = ord("|")
        marks[place_b[b_before[1:] - 1]] = ord(";")
        out = self.digits.joined(ids)
        ends = np.cumsum(self.digits.lengths[ids])
        out[ends - 1] = marks
        held = out.tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [hashlib.sha256(held[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(cuts[:-1], cuts[1:], strict=True)]


_ALIGNERS: dict[str, Aligner] = {}


def aligner(spec: Broadcast, model: Broadcast) -> Aligner:
    """The worker's own aligner of two tokenizer files, kept between tasks."""
    key = hashlib.sha1(spec.value.encode() + model.value).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(spec.value, model.value)
    return _ALIGNERS[key]


def by_text(text: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each text, and how often each has them."""
    key, n = np.unique(text.astype(np.int64) << 44 | pair, return_counts=True)
    return key >> 44, key & ((1 << 44) - 1), n


class Counts:
    """Counts of the table's pairs, and the highest count of each id of A."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, complete: bool) -> None:
        order = np.argsort(pairs)
        self.pairs, self.counts, self.best, self.complete = pairs[order], counts[order], best, complete

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's count, or 0 where the table doesn't tell it."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        found = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
        return np.where(found, self.counts[at] if len(self.pairs) else 0, 1 if self.complete else 0)


def linked_pairs(rows: DataFrame, spec: Broadcast, model: Broadcast, kind: np.dtype) -> DataFrame:
    """Each row's key, counts of tokens, groups and links, its groups' digest, its distinct linked pairs (as ``kind``) and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(spec, model)
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                told = align(part.column("text"))
                row, pair, times = by_text(told.text, told.pair)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                some = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((cuts * t.itemsize).astype(np.int32)), pa.py_buffer(x.astype(t))]) for x, t in ((pair, kind), (times, np.dtype("<u4")))]
                out = [told.n_a, told.n_b, told.n_groups, told.n_links]
                yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, out), pa.array(told.groups, pa.string()), *some], ["key", *COLUMNS[:4], "groups_sha256", "pairs", "times"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COLUMNS[:4])}, groups_sha256 string, pairs binary, times binary")


def numbers_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What binary cells hold as numbers, on end, and how many each row has."""
    held, at = raw_text(column)
    return held.view(kind).astype(np.int64), np.diff(at) // kind.itemsize


def pair_counts(linked: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n): of each pair of ids, how many documents hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, size = [], [], 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            every, n = np.concatenate([*pairs, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            return every[begins], np.add.reduceat(n, begins) if len(begins) else n

        def given(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pair), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 65536]), pa.array(n[at : at + 65536])], ["pair", "n"])

        for batch in batches:
            for part in bounded_slices(batch, "pairs", SLICE_BYTES):
                pair, n = np.unique(numbers_of(part.column("pairs"), kind)[0], return_counts=True)
                pairs.append(pair)
                counts.append(n)
                size += len(pair)
                if size > 2 * HELD:
                    pair, n = reduced()
                    if len(pair) > HELD:
                        yield from given(pair, n)
                        pair, n = pair[:0], n[:0]
                    pairs, counts, size = [pair], [n], len(pair)
        yield from given(*reduced())

    return linked.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def counted(linked: DataFrame, kind: np.dtype, wide: int, vocabulary: int, table: int) -> tuple[DataFrame, Counts]:
    """All pairs' counts as a table, and the part of them that is sent to all tasks."""
    pairs = materialize(pair_counts(linked, kind), "pairs")
    best = np.zeros(vocabulary, np.int64)
    for r in pairs.groupBy(F.expr(f"pair div {wide}").cast("int").alias("a")).agg(F.max("n").alias("n")).toLocalIterator():  # as many rows as ids at most
        best[r["a"]] = r["n"]
    # The least count that the table holds whole, from a histogram of bounded size: exact counts to 1000, then powers of two.
    level = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.expr("cast(shiftleft(1L, cast(floor(log2(n)) as int)) as long)"))
    held, least = 0, None
    for r in sorted(pairs.where("n >= 2").groupBy(level.alias("least")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["least"]):
        if held + r["c"] > table:
            break
        held, least = held + r["c"], r["least"]
    rest = pairs.where("n >= 2").count() - held
    if least is None:
        return pairs, Counts(np.zeros(0, np.int64), np.zeros(0, np.int64), best, rest == 0)
    sent = pairs.where(F.col("n") >= int(least)).toArrow()
    return pairs, Counts(np.asarray(sent["pair"]).astype(np.int64), np.asarray(sent["n"]).astype(np.int64), best, rest == 0)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", table: int = TABLE) -> DataFrame:
    """One row per row of ``docs``: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    spec = share(docs, a_path)
    with open(b_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    here = Aligner(spec.value, model.value)
    wide, vocabulary = here.wide, len(here.pool.lengths)
    if wide * vocabulary >= 1 << 44:
        raise ValueError("the vocabularies are too large for pairs of 44 bits")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = np.dtype("<u4" if wide * vocabulary <= 1 << 32 else "<i8")
    linked = materialize(linked_pairs(rows, spec, model, kind), "linked")
    pairs, counts = counted(linked, kind, wide, vocabulary, table)
    sent = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in bounded_slices(batch, "pairs", SLICE_BYTES):
                n = part.num_rows
                pair, sizes = numbers_of(part.column("pairs"), kind)
                times, row = numbers_of(part.column("times"), np.dtype("<u4"))[0], np.repeat(np.arange(n), sizes)
                count = known.of(pair)
                best = np.bincount(row, weights=times * ((count > 0) & (count == known.best[pair // wide])), minlength=n).astype(np.int64)
                total = np.zeros(n, np.int64)
                np.add.at(total, row, times * count)
                left = count == 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=n))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(times[left].astype(np.int64))], ["pair", "times"]))
                told = [part.column(c) for c in ("key", *COLUMNS[:4])]
                yield pa.RecordBatch.from_arrays([*told, pa.array(best), pa.array(total), part.column("groups_sha256"), rest], ["key", *COLUMNS, "groups_sha256", "rest"])

    out = linked.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string, rest array<struct<pair: long, times: long>>")
    if counts.complete:  # every count is told; nothing is left to join
        release_later(pairs)
        return out.drop("rest").withColumnRenamed("key", key)
    out = materialize(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
    best = spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts.best) if n], "a int, most long")
    left = out.select("row", F.explode("rest").alias("x")).select("row", "x.pair", "x.times")
    found = left.join(pairs, "pair").withColumn("a", F.expr(f"cast(pair div {wide} as int)")).join(F.broadcast(best), "a")  # as many rows as ids of A
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = out.drop("rest").join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return out.select(F.col("key").alias(key), *COLUMNS, "groups_sha256")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def release_later(pairs: DataFrame) -> None:
    """The counts are in the table that was sent; nothing reads them any more."""
    release(pairs)
