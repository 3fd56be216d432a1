"""Benchmark decontamination by SimHash windows.

For each benchmark item of n words the documents' windows of n words, at every
position, are compared with it. Similarity is the weighted overlap of five-word
shingles (each with its number of occurrences), shared weight over the larger
total. An item is found in a document where some window reaches the threshold.

The k-th occurrence of a shingle is an element of its own, so the weighted
overlap is the overlap of two sets, and a window that reaches the threshold has
an angle of at most arccos(0.8) to the item. Each bit of a SimHash over the
elements differs then with a chance of 0.205 at most, whatever the texts are, and
of 128 bits more than ``RADIUS`` differ with a chance of less than 3 in a million.

Candidates are found by blocks: fingerprints within the radius differ in at most
``FLIPS`` bits in one of the 16 blocks of 8 bits, and a table for each block and
value names the items that near it, so no fingerprint within the radius is
missed. Their distance is then taken over all bits, and what lies within the
radius is verified exactly. A radius that loses nothing at 0.8 is wide, so the
blocks alone would leave most items of a size as candidates of any window; but
only windows are fingerprinted in which enough shingles, by place, belong to
some item of their size to reach the threshold. That leaves none out and passes
few windows besides those that hold an item.

The benchmark is read in blocks of bounded size; each is broadcast and takes one
pass over the documents, without a shuffle. Whole texts are read, in slices, and
fingerprints are made in pieces of bounded size, whatever the items' lengths.

Nulls and empty texts contain nothing; null or empty items are found nowhere.
Items of fewer than five words have one shingle, their whole sequence. A document
shorter than an item is one window. Repeated documents or items give their own
rows; a null id stays null. Ties between windows go to the first. An empty table
on either side gives no row. Other columns, whatever their names, aren't read by
``find_benchmark`` and pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_slices
from .words import U, Words, mix, ngrams, words_of

SHINGLE = 5
THRESHOLD = 0.8
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20  # of benchmark texts at once
VOCABULARY_BITS = 20
BITS = 128  # of a fingerprint
RADIUS = 48
BLOCKS = BITS // 8
FLIPS = RADIUS // BLOCKS
AT_ONCE = 1 << 14  # elements that are fingerprinted at once
PAIRS_AT_ONCE = 1 << 20  # of windows and items
#: NEAR[v, w]: whether two values of a block differ in FLIPS bits at most.
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= FLIPS


def elements(grams: np.ndarray) -> np.ndarray:
    """Each row's shingles, told apart by occurrence: the same number of rows and columns, in any order."""
    grams = np.sort(grams, axis=1)
    place = np.broadcast_to(np.arange(grams.shape[1]), grams.shape)
    begins = np.ones(grams.shape, bool)
    begins[:, 1:] = grams[:, 1:] != grams[:, :-1]
    nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
    return mix(grams + nth.astype(U) * U(0xD1B54A32D192ED03))


def fingerprints(held: np.ndarray) -> np.ndarray:
    """SimHash of each row of elements, as BLOCKS bytes; read in pieces of at most ``AT_ONCE`` elements."""
    out = np.zeros((len(held), BLOCKS), np.uint8)
    wide = max(1, min(held.shape[1], AT_ONCE))
    step = max(1, AT_ONCE // wide)
    for at in range(0, len(held), step):
        rows = held[at : at + step]
        ones = np.zeros((len(rows), BITS), np.int64)
        for a in range(0, held.shape[1], wide):
            some = rows[:, a : a + wide]
            both = np.stack([some, mix(some ^ U(0xA5A5))], axis=2).view(np.uint8)
            ones += np.unpackbits(both, axis=2).sum(axis=1, dtype=np.int32)
        out[at : at + step] = np.packbits(2 * ones > held.shape[1], axis=1)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(U) ^ b.view(U)).sum(axis=1, dtype=np.int64)


def least_shared(n: int) -> int:
    """How many of a window's shingles must occur in an item of n words for it to reach the threshold."""
    return -(-int(round(100 * THRESHOLD)) * (n - shingle_words(n) + 1) // 100)


def shingle_words(n: int) -> int:
    return min(SHINGLE, n)


def reaching(places: np.ndarray, least: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges (first, last), in order, of all starts s with ``least`` of the sorted ``places`` in s..s + span."""
    if len(places) < least:
        return places[:0], places[:0]
    first, last = places[least - 1 :] - span, places[: len(places) - least + 1]
    keep = first <= last
    first, last = first[keep], last[keep]
    first[1:] = np.maximum(first[1:], last[:-1] + 1)
    keep = first <= last
    return first[keep], last[keep]


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of disjoint ranges."""
    sizes = last - first + 1
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def contains(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class SizeIndex:
    """Items of one number of words: their shingles, their fingerprints by block, and their elements."""

    def __init__(self, n: int, items: np.ndarray, grams: np.ndarray) -> None:
        self.n, self.items, self.total = n, items, grams.shape[1]
        self.grams = np.unique(grams)
        held = elements(grams)
        self.prints = fingerprints(held)
        self.tables = [np.packbits(NEAR[:, self.prints[:, b]], axis=1) for b in range(BLOCKS)]
        self.members = np.sort(self.of_item(held, np.arange(len(items))).ravel())

    @staticmethod
    def of_item(held: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(held ^ mix(item.astype(U) + U(3))[:, None])

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of prints, item) for all that lie within the radius."""
        step = max(1, PAIRS_AT_ONCE // len(self.items))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            named = self.tables[0][some[:, 0]].copy()
            for b in range(1, BLOCKS):
                named |= self.tables[b][some[:, b]]
            which, item = np.nonzero(np.unpackbits(named, axis=1, count=len(self.items)))
            good = distances(some[which], self.prints[item]) <= RADIUS
            yield which[good] + at, item[good]

    def shared(self, held: np.ndarray, which: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For each pair of a row and an item, how many elements they share, exactly."""
        out, step = np.zeros(len(item), np.int64), max(1, PAIRS_AT_ONCE // held.shape[1])
        for at in range(0, len(item), step):
            to = slice(at, at + step)
            out[to] = contains(self.members, self.of_item(held[which[to]], item[to])).sum(axis=1)
        return out


@dataclass
class Found:
    doc: np.ndarray
    item: np.ndarray
    similarity: np.ndarray
    first: np.ndarray


class Index:
    """What a block of the benchmark is searched by."""

    def __init__(self, texts: list[str]) -> None:
        words = words_of(pa.array(texts, pa.string()))
        by_size = defaultdict(list)
        for i, (a, b) in enumerate(zip(words.ends_of[:-1], words.ends_of[1:], strict=True)):
            if b > a:
                by_size[int(b - a)].append((i, a))
        self.sizes, grams = [], defaultdict(list)
        every = {k: ngrams(words.hashes, k) for k in {shingle_words(n) for n in by_size}}
        for n, held in sorted(by_size.items()):
            k = shingle_words(n)
            starts = np.array([a for _, a in held])
            self.sizes.append(SizeIndex(n, np.array([i for i, _ in held]), every[k][starts[:, None] + np.arange(n - k + 1)]))
            grams[k].append(self.sizes[-1].grams)
        self.known = {}
        for k, held in grams.items():
            sorted_, seen = np.unique(np.concatenate(held)), np.zeros(1 << VOCABULARY_BITS, bool)
            seen[self.slots(sorted_)] = True
            self.known[k] = sorted_, seen

    @staticmethod
    def slots(grams: np.ndarray) -> np.ndarray:
        return (grams >> U(64 - VOCABULARY_BITS)).view(np.int64)

    def hits(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Places whose ``k`` words are a shingle of any item."""
        sorted_, seen = self.known[k]
        at = np.flatnonzero(seen[self.slots(grams)])
        return at[contains(sorted_, grams[at])]

    def search(self, words: Words) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word of the best window), one for each text and item that is found in it."""
        ends, hashes, found = words.ends_of, words.hashes, []
        if not len(hashes):
            return
        counts = np.diff(ends)
        doc = np.repeat(np.arange(len(counts)), counts)
        grams = {k: ngrams(hashes, k) for k in self.known}
        hits = {k: self.hits(grams[k], k) for k in self.known}
        for size in self.sizes:
            n, least, k = size.n, least_shared(size.n), shingle_words(size.n)
            at, span = hits[k], n - k
            at = at[contains(size.grams, grams[k][at])]
            starts = spread(*reaching(at, least, span))
            starts = starts[(starts >= 0) & (starts + n <= len(hashes))]
            starts = starts[doc[starts] == doc[starts + n - 1]]
            found += self._verified(size, starts, span + 1, at, grams[k], doc, ends)
            # Documents of fewer words than the item are one window each.
            ends_at = np.searchsorted(at, ends)
            for d in np.flatnonzero((counts < n) & (counts >= k) & (np.diff(ends_at) >= least)):
                found += self._verified(size, ends[d : d + 1], int(counts[d]) - k + 1, at, grams[k], doc, ends)
        if not found:
            return
        all_ = [np.concatenate([getattr(f, c) for f in found]) for c in ("doc", "item", "similarity", "first")]
        order = np.lexsort((all_[3], -all_[2], all_[1], all_[0]))
        d, i, s, first = (x[order] for x in all_)
        best = np.ones(len(d), bool)
        best[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        yield from zip(d[best].tolist(), i[best].tolist(), s[best].tolist(), first[best].tolist(), strict=True)

    @staticmethod
    def _verified(size: SizeIndex, starts: np.ndarray, wide: int, at: np.ndarray, grams: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> Iterator[Found]:
        """Windows of ``wide`` shingles from ``starts``: those within the radius of an item, compared with it exactly.

        Windows come in order of how many of their places (``at``) belong to items of the size. Where the size has one item, as
        is likely for long ones, that number bounds the similarity, so windows that can't be the best of their text are left.
        """
        places = np.searchsorted(at, starts + wide) - np.searchsorted(at, starts)
        order = np.lexsort((starts, -places))
        starts, places, step = starts[order], places[order], max(1, PAIRS_AT_ONCE // wide)
        most, first = np.zeros(len(ends)), np.full(len(ends), len(grams) + 1)
        while len(starts):
            some, starts = starts[:step], starts[step:]
            held = elements(grams[some[:, None] + np.arange(wide)])
            for which, item in size.near(fingerprints(held)):
                similarity = size.shared(held, which, item) / max(size.total, wide)
                good = similarity >= THRESHOLD - 1e-12
                got, similarity = some[which[good]], similarity[good]
                yield Found(doc[got], size.items[item[good]], similarity, got - ends[doc[got]])
                np.maximum.at(most, doc[got], similarity)
                top = similarity == most[doc[got]]
                first[doc[got[top]]] = len(grams) + 1
                np.minimum.at(first, doc[got[top]], got[top])
            places = places[step:]
            if len(size.items) == 1:
                bound, best = places / max(size.total, wide), most[doc[starts]]
                keep = (bound > best) | ((bound == best) & (starts < first[doc[starts]]))
                starts, places = starts[keep], places[keep]


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark in blocks of bounded size, in order of id, streamed to the driver."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").orderBy("k", "t").toLocalIterator():
        if texts and size + len(r["t"]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["k"])
        texts.append(r["t"])
        size += len(r["t"])
    if texts:
        yield ids, texts


def find_benchmark(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: key, item_key, similarity, first_word (of the best window, from 0)."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows, out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), None
    for ids, texts in item_blocks(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((ids, Index(texts)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, index = sent.value
            for batch in batches:
                for part in bounded_slices(batch, "text", SLICE_BYTES):
                    if found := list(index.search(words_of(part.column("text")))):
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([f[0] for f in found])), pa.array([names[f[1]] for f in found]), pa.array([f[2] for f in found]), pa.array([f[3] for f in found], pa.int64())], ["key", "item", "similarity", "first_word"])

        one = rows.mapInArrow(run, f"key {kind}, item {item_kind}, similarity double, first_word long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"key {kind}, item {item_kind}, similarity double, first_word long")
    return out.withColumnsRenamed({"key": key, "item": item_key})


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that contain a benchmark item."""
    at = docs.columns.index(text)
    for _, texts in item_blocks(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(Index(texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                for part in bounded_slices(batch.rename_columns([str(i) for i in range(len(names))]), str(at), SLICE_BYTES):
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in sent.value.search(words_of(part.column(at)))]] = False
                    yield part.filter(pa.array(clean)).rename_columns(names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
