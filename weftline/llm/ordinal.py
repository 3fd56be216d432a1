"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed: its distinct words, their beginnings and ends,
and how far it repeats itself; a text without words has a feature that says so.
One weight vector gives a score s; ordered thresholds t_1 < t_2 < ... turn it into
grades by P(grade >= k) = sigma(s - t_k). The expected grade and the chance of the
top grade are used for selection.

Features are chosen by how much their presence tells of the grades (likelihood
ratio G^2 of at least 25, in 5 labelled rows or more): at most 8192 that speak
against the top grade and 1024 that speak for it. The first count 1 each. The
second share a total of 1 in a text, whatever their number, so that the many plain
words of a long text can't outweigh a few bad ones. Weights of both kinds are
learnt, with a penalty on their squares.

The model is fitted on a bounded sample of labelled rows: at most ``max_rows``
rows, chosen by a hash of their ids, of texts of at most ``max_bytes`` bytes,
so what reaches the driver is bounded whatever the corpus. Scoring reads every
whole text where it lies, with one small broadcast of weights and no shuffle.

Nulls: a null text is empty; labels with a null rating or id are left out of
fitting; several labels of a document count each. With fewer than two grades among the labels
there is nothing to learn: every text gets the top grade. Very long texts are
read whole. An empty table of texts gives no row, an empty one of labels nothing to
learn. Repeated rows are scored each. Other columns, whatever their names, pass
through ``select_quality`` untouched and aren't read by ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_slices
from .words import U, Words, substring_hashes, words_of

BITS = 18
SLICE_BYTES = 1 << 20
MAX_ROWS = 8192
MAX_BYTES = 32 << 10
NOTHING = 4242  # the feature of a text without words


def features(words: Words, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: (text, feature) pairs in order; where given, only those marked in ``used``."""
    n = len(words.ends_of) - 1
    counts = np.diff(words.ends_of)
    doc = np.repeat(np.arange(n, dtype=np.uint64), counts)
    begin, end = words.starts, words.ends
    kinds = [words.hashes]
    ranges = [(begin, np.minimum(begin + size, end)) for size in (4, 5, 6)] + [(np.maximum(end - 3, begin), end)]
    kinds += substring_hashes(words, ranges)
    keys = []
    for h in kinds:
        h = h >> U(64 - BITS)
        if used is None:
            keys.append((doc << U(BITS)) | h)
        else:
            hit = np.flatnonzero(used[h.view(np.int64)])
            keys.append((doc[hit] << U(BITS)) | h[hit])
    # How many words equal the word before, and how few are distinct, by tenths.
    if len(words.hashes):
        same = np.zeros(len(doc), bool)
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
        runs = np.bincount(doc.astype(np.int64), same, n)
        pairs = np.sort((doc << U(40)) | (words.hashes >> U(24)))
        distinct = np.bincount((pairs[np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))] >> U(40)).astype(np.int64), minlength=n)
        some = np.maximum(counts, 1)
        held = np.flatnonzero(counts).astype(np.uint64)
        for salt, share in ((11, runs / some), (12, distinct / some)):
            tenth = np.minimum((share * 10).astype(np.uint64), U(9))[held.astype(np.int64)]
            keys.append((held << U(BITS)) | (tenth * U(97) + U(salt * 1009)))
            if used is not None:
                keys[-1] = keys[-1][used[(keys[-1] & U((1 << BITS) - 1)).view(np.int64)]]
    if used is None or used[NOTHING]:
        keys.append((np.flatnonzero(counts == 0).astype(np.uint64) << U(BITS)) | U(NOTHING))
    out = np.unique(np.concatenate(keys))
    return (out >> U(BITS)).astype(np.int64), (out & U((1 << BITS) - 1)).astype(np.int64)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, 2^BITS
    thresholds: np.ndarray
    upward: np.ndarray  # which features speak for the top grade

    @property
    def used(self) -> np.ndarray:
        return self.weights != 0

    def scores(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[feature].astype(np.float64) * shares(doc, self.upward[feature], n), n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -50, 50)))


def shares(doc: np.ndarray, upward: np.ndarray, n: int) -> np.ndarray:
    """What each (text, feature) pair counts: 1, and for features that speak for the top grade one part of their number in the text."""
    return np.where(upward, 1 / np.maximum(np.bincount(doc, upward, n), 1)[doc], 1.0)


def telling(rows: list[np.ndarray], grades: np.ndarray, levels: int, least_rows: int, least_gain: float, most_against: int, most_for: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features to learn, those of enough rows whose presence tells most of the grades, and which speak for the top grade."""
    seen = np.zeros((1 << BITS, levels))
    for r, k in zip(rows, grades, strict=True):  # a row's features are distinct
        seen[r, k] += 1
    total, n, found = np.bincount(grades, minlength=levels).astype(float), float(len(grades)), seen.sum(1)
    gain = np.zeros(1 << BITS)
    for part, size in ((seen, found), (total - seen, n - found)):
        expected = np.maximum(size[:, None] * total / n, 1e-12)
        gain += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-12) / expected), 0.0).sum(1)
    gain[found < least_rows] = 0
    upward, keep = seen[:, -1] * n >= found * total[-1], np.zeros(1 << BITS, bool)
    for side, most in ((~upward, most_against), (upward, most_for)):
        own = np.where(side, gain, 0)
        keep |= own >= max(least_gain, np.partition(own, -most)[-most])
    return keep, upward


def objective(w: np.ndarray, thresholds: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of the grades with the penalty, and its gradients by weights and thresholds.

    ``pairs`` are (row, place in w, value) of all features of the rows.
    """
    doc, at, value = pairs
    levels = len(thresholds) + 1
    s = np.bincount(doc, w[at] * value, len(grades))
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    up = 1 / (1 + np.exp(-np.clip(edges[grades + 1] - s, -50, 50)))  # P(y <= grade)
    low = 1 / (1 + np.exp(-np.clip(edges[grades] - s, -50, 50)))
    up, low = np.where(grades == levels - 1, 1.0, up), np.where(grades == 0, 0.0, low)
    p = np.maximum(up - low, 1e-9)
    d_up, d_low = up * (1 - up) / p * weight, low * (1 - low) / p * weight
    g_t = np.zeros(levels + 1)
    np.add.at(g_t, grades + 1, -d_up)
    np.add.at(g_t, grades, d_low)
    loss = -(np.log(p) * weight).sum() + penalty / 2 * (w * w).sum()
    return loss, np.bincount(at, (d_up - d_low)[doc] * value, len(w)) + penalty * w, g_t[1:-1]


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, steps: int = 200, rate: float = 0.1, penalty: float = 3e-4, least_rows: int = 5, least_gain: float = 25.0, most_against: int = 8192, most_for: int = 1024) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows, with the thresholds as a first value and positive gaps."""
    keep, upward = telling(rows, grades, levels, least_rows, least_gain, most_against, most_for)
    rows = [r[keep[r]] for r in rows]
    doc, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    used, at = np.unique(feature, return_inverse=True)
    pairs = doc, at, shares(doc, upward[feature], len(rows))
    tails = np.clip(np.array([np.mean(grades >= k) for k in range(1, levels)]), 1e-3, 1 - 1e-3)
    first = np.sort(-np.log(tails / (1 - tails)))
    w = np.zeros(len(used))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    # Each grade counts alike, so that rare grades are learnt too.
    count = np.bincount(grades, minlength=levels)
    weight = (len(rows) / np.maximum(count, 1) / np.count_nonzero(count))[grades] ** 0.5
    weight /= weight.sum()
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, steps + 1):
        thresholds = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        _, g_w, g_t = objective(w, thresholds, pairs, grades, weight, penalty)
        g_raw = np.concatenate([[g_t.sum()], np.exp(raw[1:]) * np.cumsum(g_t[::-1])[::-1][1:]])
        for x, g, i in ((w, g_w, 0), (raw, g_raw, 2)):
            state[i] += 0.1 * (g - state[i])
            state[i + 1] += 0.01 * (g * g - state[i + 1])
            x -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))]), upward)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades of the public labels: 0 poor, 1 toxic, 2 good; null where a rating is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def fit_ordinal(docs: DataFrame, labels: DataFrame, levels: int = 3, key: str = "doc_id", text: str = "text", grade: str = "grade", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> OrdinalModel | None:
    """Fits on a bounded sample of the labelled rows; None if fewer than two grades are found.

    ``labels`` has the key and an integer grade from 0 to levels - 1.
    """
    rated = labels.select(F.col(key).cast("long").alias("key"), F.col(grade).cast("int").alias("grade")).where(F.col("key").isNotNull() & F.col("grade").between(0, levels - 1))
    chosen = rated.orderBy(F.xxhash64("key"), "key", "grade").limit(max_rows)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.octet_length("text") <= max_bytes)
    joined = texts.join(F.broadcast(chosen), "key").select("key", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                doc, feature = features(words_of(part.column("text")))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                held = feature.astype("<i4")
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("grade"), pa.array([held[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["key", "grade", "features"])

    rows = sorted(joined.mapInArrow(run, "key long, grade int, features binary").collect(), key=lambda r: (r["key"], r["grade"], r["features"]))
    grades = np.array([r["grade"] for r in rows], np.int64)
    if len(np.unique(grades)) < 2:
        return None
    return fit([np.frombuffer(r["features"], "<i4") for r in rows], grades, levels)


def score_quality(docs: DataFrame, model: OrdinalModel | None, levels: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, score, expected_grade and tail_probability (of the top grade)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, rated(sent.value, part.column("text"), levels))], ["key", "score", "expected_grade", "tail_probability"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, expected_grade double, tail_probability double")
    return out.withColumnRenamed("key", key)


def rated(model: OrdinalModel | None, column: pa.Array, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, expected grade and chance of the top grade of each text of a slice."""
    n = len(column)
    if model is None:
        return np.zeros(n), np.full(n, float(levels - 1)), np.ones(n)
    doc, feature = features(words_of(column), model.used)
    s = model.scores(doc, feature, n)
    tails = model.tails(s)
    return s, tails.sum(axis=1), tails[:, -1]


def select_quality(docs: DataFrame, model: OrdinalModel | None, levels: int = 3, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose chance of the top grade is at least ``least``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in bounded_slices(batch.rename_columns([str(i) for i in range(len(names))]), str(at), SLICE_BYTES):
                yield part.filter(pa.array(rated(sent.value, part.column(at), levels)[2] >= least)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
