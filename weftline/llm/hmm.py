"""Hidden Markov language model.

Latent states are trained by Baum-Welch: each pass computes expected counts by
the scaled forward-backward recursion wherever the texts lie, and the counts
are added up over two levels of tasks, so no task's input grows with the number
of partitions alone. Scores are exact: the scaled forward recursion over a whole
text's symbols, plus each word's probability within its symbol.

A token's symbol is its own if it is among the most frequent, else the class of
its ending. Token counts are taken over all training documents. The counts of
the most frequent ``TABLE`` tokens (a fixed bound) that occur ``RARE`` times or
more are sent to all tasks; the counts of all others are joined by a shuffle, so
every count is exact. A token of one or two occurrences is dearer to send to
every task than to join, as it saves a row or two.

Texts are trained on whole. A long one is cut into segments that are read side by
side: the product of a segment's steps, a matrix of states by states, carries the
forward and the backward vectors over it, so what each segment begins and ends
with is exact, and so are the moves over its borders. Texts of like length are
read together, and a group's padded area is bounded, so memory doesn't depend on
how lengths mix.

Training documents are those for which ``held_out`` is false: the CRC-32 of the id's text modulo 7 is not 2 (a null id
counts as an empty text). Null and empty texts hold the end token alone. With no training document all probabilities
are those of an empty count: base and model score 0. Repeated rows are scored each; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_slices, materialize, partitions
from .words import U, Words, mix, substring_hashes, words_of

STATES = 8
OWN = 4096  # symbols of single tokens, the end token's among them
CLASSES = 512
SYMBOLS = OWN + CLASSES
TABLE = 2_000_000
RARE = 3  # tokens of fewer occurrences are never in the table, at any size
ROUNDS = 5
SEGMENT = 512  # steps of a segment of a long text
LONG = 2048  # texts of more tokens are cut into segments
SLICE_BYTES = 1 << 20
TOKENS_AT_ONCE = 1 << 21
CELLS = 1 << 19  # steps times texts of a group
RESCALED = 8  # steps between two scalings of a product
END = int(mix(np.array([0xE0F], U)).view(np.int64)[0])
FAN_IN = 64


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens, the end token after each text's words, and the tokens before each text's end."""
    n = len(words.ends_of) - 1
    at = words.ends_of[1:]
    (tail,) = substring_hashes(words, [(np.maximum(words.ends - 3, words.starts), words.ends)])
    hashes = np.insert(words.hashes.view(np.int64), at, END)
    classes = np.insert((tail % U(CLASSES)).astype(np.uint16), at, 0)
    return hashes, classes, words.ends_of + np.arange(n + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, class, c) of all tokens of ``docs`` (a text column)."""
    buckets = 4 * partitions(docs.sparkSession)
    kind = np.dtype([("token", "<i8"), ("class", "<u2"), ("c", "<i8")])

    def summed(hashes: np.ndarray, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        order = np.argsort(hashes, kind="stable")
        hashes, classes, c = hashes[order], classes[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        out = np.zeros(len(begin), kind)
        if len(begin):
            out["token"], out["class"], out["c"] = hashes[begin], classes[begin], np.add.reduceat(c, begin)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                h, k, _ = tokens(words_of(part.column("text")))
                parts.append(summed(h, k, np.ones(len(h), np.int64)))
            got = np.concatenate([*parts, np.zeros(0, kind)])
            got = summed(got["token"], got["class"], got["c"])
            bucket = mix(got["token"].view(U)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
            rows = [(i, got[o].tobytes()) for i in range(buckets) if len(o := order[at[i] : at[i + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = np.zeros(0, kind), [], 0
        for batch in batches:
            for blob in batch.column(1):
                waiting.append(np.frombuffer(blob.as_buffer(), kind))
                size += len(waiting[-1])
                if size > 2_000_000:
                    got = np.concatenate([held, *waiting])
                    held, waiting, size = summed(got["token"], got["class"], got["c"]), [], 0
        got = np.concatenate([held, *waiting])
        got = summed(got["token"], got["class"], got["c"])
        for at in range(0, len(got), 65536):
            x = got[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["token"])), pa.array(x["class"].astype(np.int32)), pa.array(np.ascontiguousarray(x["c"]))], ["token", "class", "c"])

    return docs.select("text").mapInArrow(count, "bucket int, packed binary").repartition(partitions(docs.sparkSession), "bucket").mapInArrow(add, "token long, class int, c long")


class Table:
    """Counts and symbols of the most frequent tokens, looked up many at once."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((tokens, -counts))
        tokens, counts = tokens[order], counts[order]
        symbols = np.full(len(tokens), -1, np.int32)
        own = np.flatnonzero(tokens != END)[: OWN - 1]
        symbols[own] = np.arange(1, len(own) + 1)
        symbols[tokens == END] = 0
        self.bits = max(10, int(2 * len(tokens)).bit_length())
        n = 1 << self.bits
        self.keys, self.counts, self.symbols, self.full = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n, bool)
        open_, at = np.arange(len(tokens)), self._start(tokens)
        while len(open_):
            _, first = np.unique(at, return_index=True)
            take = first[~self.full[at[first]]]
            slot, which = at[take], open_[take]
            self.keys[slot], self.counts[slot], self.symbols[slot], self.full[slot] = tokens[which], counts[which], symbols[which], True
            left = np.ones(len(open_), bool)
            left[take] = False
            open_, at = open_[left], at[left]
            at = np.where(self.full[at], (at + 1) & (n - 1), at)
        self.own = {int(s): int(c) for s, c in zip(symbols, counts, strict=True) if s >= 0}

    def _start(self, tokens: np.ndarray) -> np.ndarray:
        return (mix(tokens.view(U)) >> U(64 - self.bits)).view(np.int64)

    def owners(self, tokens: np.ndarray) -> np.ndarray:
        """The symbols of tokens that have one of their own, else -1; 0 is the end token's."""
        slots = self.find(tokens)
        return np.where(slots >= 0, self.symbols[slots], -1)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Slot of each token, or -1."""
        out = np.full(len(tokens), -1, np.int64)
        open_, at = np.arange(len(tokens)), self._start(tokens)
        while len(open_):
            hit = self.full[at] & (self.keys[at] == tokens[open_])
            out[open_[hit]] = at[hit]
            go = ~hit & self.full[at]
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class Model:
    first: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # states x symbols

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, moves and emissions of whole sequences, by forward-backward."""
        totals = np.zeros_like(self.first), np.zeros_like(self.moves), np.zeros_like(self.emits)
        texts = [t for t in texts if len(t)]
        pieces, enters, ends = [t for t in texts if len(t) <= LONG], [], []
        whole = len(pieces)
        if cut := [segments(t) for t in texts if len(t) > LONG]:
            steps, _ = self.products([p for t in cut for p in t])
            at = 0
            for t in cut:
                enter, end = self.borders(steps[at : at + len(t)])
                at += len(t)
                pieces += t
                enters.append(enter)
                ends.append(end)
        # A row of zeros: nothing comes before, the text begins here.
        enter = np.concatenate([np.zeros((whole, len(self.first))), *enters])
        end = np.concatenate([np.ones((whole, len(self.first))), *ends])
        for some in groups(pieces):
            for total, more in zip(totals, self._counts([pieces[i] for i in some], enter[some], end[some]), strict=True):
                total += more
        return totals

    def products(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the matrix from the state at its first symbol, before that is emitted, to the state at its last,
        with all its emissions; scaled, and the log10 of the scale."""
        states = len(self.first)
        out, logs = np.zeros((len(pieces), states, states)), np.zeros(len(pieces))
        likely = np.ascontiguousarray(self.emits.T)
        for some in groups(pieces, CELLS // states):
            lengths, active, held = padded([pieces[i] for i in some])
            x = np.einsum("ij,wj->wij", np.eye(states), likely[held[0]])
            log = np.zeros(len(some))
            for t in range(1, len(held)):
                n = active[t]
                x[:n] = (x[:n].reshape(-1, states) @ self.moves).reshape(n, states, states) * likely[held[t, :n], None]
                if t % RESCALED == 0 or t == len(held) - 1:
                    scale = np.maximum(x.max(axis=(1, 2)), 1e-300)
                    log += np.log10(scale)
                    x /= scale[:, None, None]
            out[some], logs[some] = x, log
        return out, logs

    def borders(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the products of a text's segments, the state's distribution before each segment (zeros before the first) and
        the backward vector at the end of each."""
        enter, end = np.zeros((len(steps), len(self.first))), np.ones((len(steps), len(self.first)))
        at = self.first
        for i in range(len(steps) - 1):
            at = at @ steps[i]
            enter[i + 1] = at / max(at.sum(), 1e-300)
            at = enter[i + 1] @ self.moves
        back = end[-1]
        for i in range(len(steps) - 1, 0, -1):
            back = self.moves @ (steps[i] @ back)
            end[i - 1] = back = back / max(back.sum(), 1e-300)
        return enter, end

    def _counts(self, texts: list[np.ndarray], enter: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one group, longest first. ``enter`` is the state's distribution one step before the first symbol."""
        first, moves, emits = np.zeros_like(self.first), np.zeros_like(self.moves), np.zeros_like(self.emits)
        lengths, active, held = padded(texts)
        steps, wide = held.shape
        begins = ~enter.any(axis=1)
        start = np.where(begins[:, None], self.first, enter @ self.moves)
        likely = np.ascontiguousarray(self.emits.T)
        alpha, scale = np.zeros((steps, wide, len(self.first))), np.ones((steps, wide))
        for t in range(steps):
            n = active[t]
            x = (start if t == 0 else alpha[t - 1, :n] @ self.moves) * likely[held[t, :n]]
            scale[t, :n] = s = np.maximum(x.sum(axis=1), 1e-300)
            alpha[t, :n] = x / s[:, None]
        beta = end / np.maximum((alpha[lengths - 1, np.arange(wide)] * end).sum(axis=1, keepdims=True), 1e-300)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            gamma = alpha[t, :n] * beta[:n]  # adds up to 1, as alpha and beta are scaled alike
            ahead = likely[held[t, :n]] * beta[:n] / scale[t, :n, None]
            if t:
                moves += self.moves * (alpha[t - 1, :n].T @ ahead)
                beta[:n] = ahead @ self.moves.T
            else:
                moves += self.moves * (enter.T @ ahead)
                first += gamma[begins].sum(axis=0)
            alpha[t, :n] = gamma
        inside = np.arange(steps)[:, None] < lengths[None, :]
        symbols = held[inside]
        for s in range(len(self.first)):
            emits[s] = np.bincount(symbols, alpha[..., s][inside], emits.shape[1])
        return first, moves, emits

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion; over long ones by segments' products."""
        out = np.zeros(len(texts))
        likely = np.ascontiguousarray(self.emits.T)
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= LONG]
        for some in groups([texts[i] for i in short]):
            which = [short[i] for i in some]
            _, active, held = padded([texts[i] for i in which])
            x, total = self.first * likely[held[0]], np.zeros(len(which))
            for t in range(1, len(held)):
                n = active[t]
                x[:n] = (x[:n] @ self.moves) * likely[held[t, :n]]
                if t % RESCALED == 0:
                    s = np.maximum(x.sum(axis=1), 1e-300)
                    total += np.log10(s)
                    x /= s[:, None]
            out[which] = total + np.log10(np.maximum(x.sum(axis=1), 1e-300))
        long = [i for i, t in enumerate(texts) if len(t) > LONG]
        cut = [segments(texts[i]) for i in long]
        steps, logs = self.products([p for c in cut for p in c])
        begin = 0
        for i, c in zip(long, cut, strict=True):
            at, total = self.first, logs[begin : begin + len(c)].sum()
            for k, step in enumerate(steps[begin : begin + len(c)]):
                at = (at if k == 0 else at @ self.moves) @ step
                s = max(at.sum(), 1e-300)
                total, at = total + np.log10(s), at / s
            out[i], begin = total, begin + len(c)
        return out


def segments(text: np.ndarray) -> list[np.ndarray]:
    return [text[at : at + SEGMENT] for at in range(0, len(text), SEGMENT)]


def groups(texts: list[np.ndarray], cells: int = CELLS) -> Iterator[np.ndarray]:
    """Positions of the texts, longest first, in groups whose longest text times their number is at most ``cells`` (or one text)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, cells // max(1, int(lengths[order[at]])))
        yield order[at:to]
        at = to


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of falling length: the lengths, how many texts reach each step, and a matrix of steps by texts."""
    lengths = np.array([len(t) for t in texts])
    steps = int(lengths[0])
    held = np.zeros((len(texts), steps), np.uint16)
    for i, t in enumerate(texts):
        held[i, : len(t)] = t
    return lengths, np.searchsorted(-lengths, -np.arange(1, steps + 1), "right"), np.ascontiguousarray(held.T)


def first_model(counts: np.ndarray, states: int = STATES) -> Model:
    """Sticky moves, and emissions near the symbols' shares, apart by fixed noise."""
    noise = np.exp(np.random.default_rng(7).normal(size=(states, len(counts))))
    emits = (counts + 1.0) * noise
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=1, keepdims=True))


def train(texts: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``texts`` (symbols: binary of uint16), ``rounds`` times."""
    spark = texts.sparkSession
    fan = max(1, min(FAN_IN, partitions(spark)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m, totals, held, size = sent.value, None, [], 0

            def add(held: list[np.ndarray]) -> None:
                nonlocal totals
                got = m.expected(held)
                totals = got if totals is None else tuple(a + b for a, b in zip(totals, got, strict=True))

            for batch in batches:
                for x in batch.column("symbols"):
                    held.append(np.frombuffer(x.as_buffer(), "<u2").copy())
                    size += len(held[-1])
                    if size >= TOKENS_AT_ONCE:
                        add(held)
                        held, size = [], 0
            add(held)
            rows = [np.concatenate([totals[0][s : s + 1], totals[1][s], totals[2][s]]).tobytes() for s in range(len(totals[0]))]
            place = TaskContext.get().partitionId() % fan
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([place] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["state", "place", "packed"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for s, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    x = np.frombuffer(x.as_buffer(), "<f8")
                    totals[s, p] = totals[s, p] + x if (s, p) in totals else x
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.int32()), pa.array([k[1] for k in totals], pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["state", "place", "packed"])

        shape = "state int, place int, packed binary"
        parts = texts.select("symbols").mapInArrow(count, shape).repartition(fan, "state", "place").mapInArrow(add_up, shape)
        states = len(model.first)
        rows = [np.zeros(1 + states + model.emits.shape[1]) for _ in range(states)]
        for r in parts.collect():  # states x FAN_IN rows of one size at most
            rows[r["state"]] += np.frombuffer(bytes(r["packed"]), "<f8")
        got = np.stack(rows)
        first, moves, emits = got[:, 0] + 1e-3, got[:, 1 : 1 + states] + 1e-3, got[:, 1 + states :] + 1e-2
        model = Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
    return model


def score_lm(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, rounds: int = ROUNDS, table: int = TABLE) -> DataFrame:
    """Counts, trains and scores: key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold).alias("held_out"))
    counts = materialize(count_tokens(rows.where("not held_out")), "counts")

    # The least count of the table's tokens, from a histogram whose size is bounded: exact counts to 1000, then powers of two.
    step = F.when(F.col("c") < 1000, F.col("c")).otherwise(1000 * F.pow(F.lit(2.0), F.floor(F.log2(F.col("c") / 1000)))).cast("long")
    sizes = counts.where(F.col("c") >= RARE).groupBy(step.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, kept = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["c"]):
        kept += r["n"]
        if kept > table:
            break
        least = r["c"]
    # The end token is always in the table, as it has a symbol of its own.
    got = counts.where((F.col("c") >= least) | (F.col("token") == END)).select("token", "class", "c").toArrow()
    found, classes, c = (np.asarray(got[x]).astype(np.int64) for x in ("token", "class", "c"))
    known = Table(found, c)

    by_class = {r["class"]: (r["n"], r["v"]) for r in counts.where(F.col("token") != END).groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total = sum(n for n, _ in by_class.values()) + known.own.get(0, 0)
    distinct = sum(v for _, v in by_class.values()) + (0 in known.own)
    for k, n in zip(*(x[known.owners(found) > 0].tolist() for x in (classes, c)), strict=True):  # fewer than OWN
        by_class[k] = (by_class[k][0] - n, by_class[k][1] - 1)
    space = np.zeros(CLASSES)  # log10 of what a class's probabilities are over
    mass = np.zeros(SYMBOLS)
    for k, (n, v) in by_class.items():
        space[k], mass[OWN + k] = np.log10(n + v + 1), n
    for s, c in known.own.items():
        mass[s] = c
    sent = spark.sparkContext.broadcast((known, space))

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, space_ = sent.value
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                hashes, classes, ends = tokens(words_of(part.column("text")))
                slots = table_.find(hashes)
                found = slots >= 0
                c = np.where(found, table_.counts[slots], 0)
                own = np.where(found, table_.symbols[slots], -1)
                own[hashes == END] = 0
                shared = own < 0
                log = np.log10(c + 1.0)
                cut = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
                within = np.where(shared, log - space_[classes], 0.0)
                symbol = np.where(shared, OWN + classes.astype(np.int64), own).astype("<u2")
                tails = hashes[~found]
                at = np.concatenate([[0], np.cumsum(~found)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("held_out"),
                        pa.array(np.diff(ends)),
                        pa.array(cut(c > 0).astype(np.int64)),
                        pa.array(cut(log)),
                        pa.array(cut(within)),
                        pa.array([symbol[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tails, pa.int64())),
                    ],
                    ["key", "held_out", "n_tokens", "n_known", "log_counts", "within", "symbols", "tail"],
                )

    shape = f"key {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, within double, symbols binary, tail array<long>"
    read = materialize(rows.select("key", "held_out", "text").mapInArrow(symbols, shape).withColumn("row", F.monotonically_increasing_id()), "symbols")
    model = train(read.where("not held_out"), first_model(mass), rounds) if total else None
    told = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("symbols")]
            like = told.value.log10(texts) if told.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_columns), pa.array(like)], [*kept_columns, "likelihood"])

    kept_columns = ["row", "key", "held_out", "n_tokens", "n_known", "log_counts", "within"]
    out = read.select(*kept_columns, "symbols").mapInArrow(score, f"row long, key {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, within double, likelihood double")
    # Tokens that the table lacks.
    tail = read.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("k"))
    more = tail.join(counts.where((F.col("c") < least) & (F.col("token") != END)), "token").groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"))
    out = out.join(more, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "log_counts": F.col("log_counts") + F.coalesce("more", F.lit(0.0)), "within": F.col("within") + F.coalesce("more", F.lit(0.0))})
    base = F.lit(float(np.log10(total + distinct + 1)))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * base).alias("base_score"), ((F.col("likelihood") + F.col("within")) if total else F.lit(0.0)).alias("score"))
