"""Byte-level BPE encoding over a prefix trie, and decoding.

Words (the pieces that the pre-tokenizer cuts) are encoded without running the
merge loop on each. The distinct new words of a batch go into a trie of bytes.
A depth-first walk gives every node, that is every prefix, one state: the last
token of the prefix's encoding. It is the one token that ends the prefix and
goes with the state of the node where it begins, so each shared prefix is worked
out once. Ids are kept by chunk (a run and the space before it), which the
pre-tokenizer never cuts across, and looked up by hash.

Nulls are empty texts (no ids). Empty texts give no ids. Very long words make
chains that are walked without recursion. Repeated rows give repeated results;
columns besides the id and the text are not read, so names may clash freely.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore, spaced_chunks
from .shared import bounded_slices, raw_text, texts

# Fixed value: the pre-tokenizer pattern of byte-level BPE files with use_regex.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes beyond which a word's states are dropped once it is done.
LONG_WORD = 4096

#: Pair verdicts kept; when full, the store starts anew.
KEPT_PAIRS = 2_000_000
SLICE_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next code point from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, spec: str) -> None:
        told = json.loads(spec)
        stand = byte_alphabet()
        vocab: dict[str, int] = told["model"]["vocab"]
        raw = {t: bytes(stand[c] for c in t) for t in vocab}
        self.id_of = {raw[t]: i for t, i in vocab.items()}
        self.bytes_of = {i: raw[t] for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank_of[left, right] = rank
            if whole not in self.made_at:
                self.made_at[whole], self.halves[whole] = rank, (left, right)
        self.cut = regex.compile(PIECES).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.store = ChunkStore(self.learn, "<u4")
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def goes_with(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of ``a`` and ``b`` leaves just these two tokens.

        Undoes the merges along the border, the latest first. If the border's two
        tokens would have merged before the merge just undone, the pair can't stand.
        Of merges of one rank, the left one comes first.
        """
        made, ranks, before = self.made_at, self.rank_of, float("inf")
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < before:
                return False
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                before, a = at_a, self.halves[a][1]
            else:
                before, b = at_b + 1, self.halves[b][0]

    def stands_alone(self, t: int) -> bool:
        """Whether BPE over the bytes of ``t`` gives ``t``."""
        if t not in self.alone:
            held = self.bytes_of[t]
            if len(held) == 1:
                self.alone[t] = True
            else:
                a, b = self.halves.get(t, (None, None))
                # The halves must stand, and nothing across their border may merge before the last merge.
                self.alone[t] = a is not None and self.stands_alone(a) and self.stands_alone(b) and self._meets(a, b, self.made_at[t])
        return self.alone[t]

    def _meets(self, a: int, b: int, last: int) -> bool:
        made, ranks, before, first = self.made_at, self.rank_of, float("inf"), True
        while True:
            rank = ranks.get((a, b))
            if not first and rank is not None and rank < before:
                return False
            first = False
            at_a, at_b = made.get(a, -1), made.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                before, a = at_a, self.halves[a][1]
            else:
                before, b = at_b + 1, self.halves[b][0]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as little-endian uint32 bytes.

        The chunks' distinct words, sorted, are a trie's leaves in depth-first
        order, and what a word shares with the one before it is the path that
        both hang from. ``last`` and ``ids`` hold the states of the nodes on the
        path to the current node; going on to the next word drops those below
        the branching and works out the new ones alone.
        """
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        cuts = [self.cut(chunk) for chunk in chunks]
        words = dict.fromkeys(w for cut in cuts for w in cut)
        lookup, pairs, longest, packed = self.id_of.get, self.pairs, self.longest, self.packed
        before, last, ids = b"", [-1], [b""]
        for held, word in sorted((w.encode(), w) for w in words):
            same, most = 0, min(len(before), len(held))
            while same < most and before[same] == held[same]:
                same += 1
            del last[same + 1 :], ids[same + 1 :]
            short = len(held) <= LONG_WORD
            for depth in range(same + 1, len(held) + 1):
                for begin in range(depth - longest if depth > longest else 0, depth):
                    token = lookup(held[begin:depth])
                    if token is None:
                        continue
                    state = last[begin]
                    pair = state << 20 | token
                    good = pairs.get(pair)
                    if good is None:
                        good = pairs[pair] = self.stands_alone(token) and (state < 0 or self.goes_with(state, token))
                    if good:
                        last.append(token)
                        if short:
                            ids.append(ids[begin] + packed[token])
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            if short:
                words[word], before = ids[-1], held
            else:  # its prefixes' ids would add up to the square of its length: step back by the states
                words[word] = self._back(last)
                before, last, ids = b"", [-1], [b""]
        return [b"".join([words[w] for w in cut]) for cut in cuts]

    def _back(self, last: list[int]) -> bytes:
        depth, out = len(last) - 1, []
        while depth:
            out.append(self.packed[last[depth]])
            depth -= len(self.bytes_of[last[depth]])
        return b"".join(reversed(out))

    def encode_batch(self, column: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes. Special tokens' strings become their ids; null counts as empty."""
        raw, at = raw_text(column)
        flat, sizes = self.store.ids(raw, at, *spaced_chunks(raw, at))
        held, cuts = flat.tobytes(), (np.concatenate([[0], np.cumsum(sizes)]) * 4).tolist()
        out = [held[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.special:
            data = raw.tobytes()
            if any(s.encode() in data for s in self.special):
                for i, text in enumerate(texts(column)):
                    if any(s in text for s in self.special):
                        out[i] = self._with_special(text)
        return out

    def _with_special(self, text: str) -> bytes:
        parts = [x for x in self.at_special.split(text) if x]
        plain = iter(self.encode_batch(pa.array([x for x in parts if x not in self.special], pa.string())))
        return b"".join(self.packed[self.special[x]] if x in self.special else next(plain) for x in parts)

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian uint32 bytes; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_BUILT: dict[str, TrieBpe] = {}


def built(spec: Broadcast | str) -> TrieBpe:
    """The worker's own encoder of a tokenizer file, kept between tasks."""
    text = spec if isinstance(spec, str) else spec.value
    key = hashlib.sha1(text.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = TrieBpe(text)
    return _BUILT[key]


def encoded(batches: Iterator[pa.RecordBatch], spec: Broadcast, key: str, text: str) -> Iterator[tuple[pa.Array, list[bytes], TrieBpe]]:
    """For bounded slices of the batches: keys, ids of each row, and the encoder."""
    bpe = None
    for batch in batches:
        bpe = bpe or built(spec)
        for part in bounded_slices(batch, text, SLICE_BYTES):
            yield part.column(key), bpe.encode_batch(part.column(text)), bpe


def share(df: DataFrame, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors (a few MB whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, n_tokens, and ids (array of int) of the whole text.

    A null text counts as empty. No shuffle; memory is bounded by one slice of texts and the stores.
    """
    spec = share(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, _ in encoded(batches, spec, "key", "text"):
            lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(lengths), lists], ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>")
    return out.withColumnRenamed("key", key)


def bpe_decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``df``: its key and the text of its ids. Null ids give the empty text."""
    spec = share(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or built(spec)
            out = [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def bpe_digests(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each whole text and returns n_tokens and the SHA-256 of the ids and of the decoded text."""
    spec = share(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, bpe in encoded(batches, spec, "key", "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
