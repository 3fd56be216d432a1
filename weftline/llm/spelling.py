"""Spelling variants: words grouped with the frequent words one edit away.

The distinct words, sorted, are cut into shards, each a compact trie. Shards are
sent to all tasks, a bounded number of words in each pass, and every word's
distance-one Levenshtein automaton is intersected with every shard from the root
down, depth-first: along the path that spells the word itself (no edit yet) each
node opens the branches of one edit, and those are followed to their ends before
the path goes on. Where an automaton can't go on a branch is left, so of shards
that begin otherwise only the roots are seen. Many words walk side by side; a
block's size is bounded. Of equal edits (a letter doubled, or one of two dropped)
only the last is opened, so each neighbour is met once. What a shard accepts is
reduced at once to a word's number of neighbours and its best one, and passes are
added up by word; neighbours aren't written as pairs.

Words are runs of Latin letters up to U+00FF with A-Z lower-cased. As the corpus
has few misspellings of its own, some are made: where 31 divides the CRC-32 of
``<id>:<run>``, the run loses one letter, so a word's counts depend on ids.

A word's form is its nearest word of the largest count, where that is ten times
the word's own at least. Counts grow tenfold along forms, so a chain of them has
18 steps at most, and doubling reaches its end in five joins.

Defined results: null texts have no runs; a null id is written as the empty text;
repeated rows count each. Ties of count go to the first word in code-point order.
Empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions, release

LEAST = 7  # code points of a word
TWICE = 2  # occurrences
TIMES = 10  # a form's count over the word's
EVERY = 31
SHARD_WORDS = 1 << 17
SHARD_LETTERS = 2 << 20  # a longer single word is a shard of its own
PASS_LETTERS = 8 << 20  # letters and counts (eight bytes each) of the shards of one pass, as sent
BLOCK = 2048  # words that walk side by side
BLOCK_LETTERS = 1 << 16


def runs(docs: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(word) of every run of ``least`` letters or more, with the letters that are lost. Shorter runs can't become words."""
    run = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    low = run.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run")).alias("run"))
    marked = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return marked.select(F.when(F.col("h") % EVERY == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


class Trie:
    """A compact trie of sorted words: nodes numbered by depth and then in order, so the children of a node follow each other."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths
        alive, parent = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        keys, self.word_at = [], [np.full(1, -1, np.int64)]
        size, depth = 1, 0
        while True:
            stay = lengths[alive] > depth
            alive, parent = alive[stay], parent[stay]
            if not len(alive):
                break
            letter = letters[starts[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            keys.append(parent[new] << 8 | letter[new])
            parent = size + np.cumsum(new) - 1
            ends = np.full(int(new.sum()), -1, np.int64)
            done = lengths[alive] == depth + 1
            ends[parent[done] - size] = alive[done]
            self.word_at.append(ends)
            size += len(ends)
            depth += 1
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])  # (parent, letter) of nodes 1, 2, ... in order
        self.word_at = np.concatenate(self.word_at).astype(np.int32)
        self.first = np.searchsorted(self.keys, np.arange(size + 1) << 8)  # children of a node are first[node] + 1 to first[node + 1]

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, or 0."""
        key = node << 8 | letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at + 1, 0)

    def near(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for each query and each word of the trie at a distance of exactly one."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        letters = np.append(letters, np.uint8(0)).astype(np.int64)  # a mark that no word holds stands after the last
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def follow(query: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
            """Branches that have had their edit: all other letters must be met as they are."""
            while len(query):
                done = at == lengths[query]
                if done.any():
                    word = self.word_at[node[done]]
                    found.append((query[done][word >= 0], word[word >= 0]))
                    query, node, at = query[~done], node[~done], at[~done]
                node = self.child(node, letters[starts[query] + at])
                go = node > 0
                query, node, at = query[go], node[go], at[go] + 1

        query, node, depth = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0
        while len(query):
            more = lengths[query] > depth
            here = np.where(more, letters[starts[query] + depth], -1)
            after = np.where(lengths[query] > depth + 1, letters[np.minimum(starts[query] + depth + 1, len(letters) - 1)], -1)
            drop = more & (here != after)
            fan = self.first[node + 1] - self.first[node]
            which = np.repeat(np.arange(len(query)), fan)
            child = np.repeat(self.first[node] + 1 - (np.cumsum(fan) - fan), fan) + np.arange(len(which))
            other = (self.keys[child - 1] & 255) != here[which]
            which, child = which[other], child[other]
            swap = more[which]
            full = np.full(len(query), depth)
            follow(
                np.concatenate([query[drop], query[which[swap]], query[which]]),
                np.concatenate([node[drop], child[swap], child]),
                np.concatenate([full[drop] + 1, full[which[swap]] + 1, full[which]]),
            )
            query, node = query[more], node[more]
            node = self.child(node, letters[starts[query] + depth])
            query, node, depth = query[node > 0], node[node > 0], depth + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found]).astype(np.int64)


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes of Latin-1, one a letter, and their lengths; its order is that of code points."""
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def shards(words: DataFrame) -> DataFrame:
    """(shard, size, letters, lengths, counts): compact shards of words that are sorted within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def packed() -> pa.RecordBatch:
            letters, lengths, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
            blobs = [letters.tobytes(), lengths.astype("<u4").tobytes(), counts.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, blobs))], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["size", "letters", "lengths", "counts"])

        for batch in batches:
            letters, lengths = letters_of(batch.column("word"))
            counts = np.asarray(batch.column("n")).astype(np.int64)
            ends, at = np.cumsum(lengths), 0
            while at < len(lengths):
                base = ends[at - 1] if at else 0
                to = min(int(np.searchsorted(ends, base + SHARD_LETTERS - size, "right")), at + SHARD_WORDS - n)
                to = max(to, at + (not held))  # a single word may be longer than a shard
                if to > at:
                    held.append((letters[base : ends[to - 1]], lengths[at:to], counts[at:to]))
                    size, n, at = size + int(ends[to - 1] - base), n + to - at, to
                if at < len(lengths):
                    yield packed()
                    held, size, n = [], 0, 0
        if held:
            yield packed()

    return words.mapInArrow(run, "size long, letters binary, lengths binary, counts binary").withColumn("shard", F.monotonically_increasing_id())


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a neighbour; ``form`` is the neighbour of the largest count."""
    spark = words.sparkSession
    # Files of a table are read the largest first, several in a task, so the order that shards need is made in the same stage.
    cut = materialize(shards(words.repartitionByRange(partitions(spark), "word").sortWithinPartitions("word")), "shards")
    passes, held = [[]], 0
    for r in cut.select("shard", "size").orderBy("shard").toLocalIterator():  # a row for each 131,072 words
        if passes[-1] and held + r["size"] > PASS_LETTERS:
            passes.append([])
            held = 0
        passes[-1].append(r["shard"])
        held += r["size"]
    told = []
    for some in passes:
        rows = cut.where(F.col("shard").between(some[0], some[-1])).orderBy("shard").collect() if some else []
        sent = spark.sparkContext.broadcast([(bytes(r["letters"]), bytes(r["lengths"]), bytes(r["counts"])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = []
            for letters, lengths, counts in sent.value:
                letters, lengths = np.frombuffer(letters, np.uint8), np.frombuffer(lengths, "<u4").astype(np.int64)
                known.append((Trie(letters, lengths), letters, np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(counts, "<i8")))

            def walked(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
                n = len(lengths)
                near, most, best = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
                for trie, spelt, at, counts in known:  # shards are in order, so of equal counts the first found is the first in order
                    query, word = trie.near(letters, lengths)
                    near += np.bincount(query, minlength=n)
                    order = np.lexsort((word, -counts[word], query))
                    query, word = query[order], word[order]
                    top = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
                    query, word = query[top], word[top]
                    better = counts[word] > most[query]
                    query, word = query[better], word[better]
                    most[query] = counts[word]
                    for q, w in zip(query.tolist(), word.tolist(), strict=True):
                        best[q] = spelt[at[w] : at[w + 1]].tobytes().decode("latin-1")
                return near, most, best

            for batch in batches:
                letters, lengths = letters_of(batch.column("word"))
                ends, at = np.cumsum(lengths), 0
                while at < len(lengths):
                    base = ends[at - 1] if at else 0
                    to = min(at + BLOCK, max(at + 1, int(np.searchsorted(ends, base + BLOCK_LETTERS, "right"))))
                    near, most, best = walked(letters[base : ends[to - 1]], lengths[at:to])
                    some = pa.array(near > 0)
                    out = [batch.column("word").slice(at, to - at), pa.array(near), pa.array(best, pa.string()), pa.array(most)]
                    yield pa.RecordBatch.from_arrays([c.filter(some) for c in out], ["word", "n_near", "form", "form_n"])
                    at = to

        told.append(materialize(words.select("word").mapInArrow(run, "word string, n_near long, form string, form_n long"), "near"))
        sent.unpersist()
    release(cut)
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))  # the largest count, then the first word
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def ends_of_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): what forms lead to in the end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = materialize(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        settled = new.where("moved").isEmpty()
        release(now)
        now = new.select("word", "root")
        now.written_at = new.written_at
        if settled:
            return now


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, twice: int = TWICE, times: int = TIMES) -> DataFrame:
    """One row for each word: word, form, root (strings), n, n_near and form_n (longs)."""
    counted = runs(docs, key, text, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= twice)
    words = materialize(counted.repartitionByRange(partitions(docs.sparkSession), "word").sortWithinPartitions("word"), "words")
    near = words.join(neighbours(words), "word", "left")
    takes = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    near = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "forms")
    release(words)
    roots = ends_of_forms(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
