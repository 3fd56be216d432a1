"""Words and word shingles of texts as arrays of hashes.

Words are maximal runs of bytes other than space and \\t to \\r, with A-Z
lower-cased; so they never depend on how texts lie in batches. All is done on
the UTF-8 bytes of a slice of texts with array operations: a word is hashed by
lanes of eight bytes, each mixed into the hash of those before it, many words at
once. Words of one lane and one length never share a hash; others do with a
chance of 2^-64 a pair. Longer words than ``LANED`` bytes are hashed by BLAKE2b
each.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .shared import raw_text

U = np.uint64
PRIME = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LANED = 128  # bytes of a word that are hashed by lanes; longer words by a digest
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  # the lowest bytes of a lane


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's steps)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def lane(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th eight bytes of byte ranges as integers, zeros beyond their ends. ``raw`` must go on for eight bytes after them."""
    every = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    return every[starts + 8 * k] & _KEPT[np.minimum(lengths - 8 * k, 8)]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges of ``raw``, which must go on for eight bytes after the last."""
    lengths = ends - starts
    out = mix(lengths.astype(U) + U(salt << 32))
    if not len(out):
        return out
    some, k, most = np.flatnonzero((lengths > 0) & (lengths <= LANED)), 0, int(lengths.max())
    while len(some):
        out[some] = mix(out[some] ^ lane(raw, starts[some], lengths[some], k))
        k += 1
        some = some[lengths[some] > 8 * k]
    if most > LANED:
        for i in np.flatnonzero(lengths > LANED).tolist():
            told = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(told, "little")
    return out


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte offsets into the slice
    ends: np.ndarray
    ends_of: np.ndarray  # for each text, how many words lie before its end; one more entry than texts, beginning with 0
    raw: np.ndarray  # the bytes as they are
    at: np.ndarray  # offsets of the texts
    low: np.ndarray  # the bytes with A-Z lower-cased and eight more, for hashes of other byte ranges


def words_of(column: pa.Array) -> Words:
    raw, at = raw_text(column)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none, np.zeros(len(column) + 1, np.int64), raw, at, np.zeros(8, np.uint8))
    space = _SPACE[raw]
    starts = ~space
    ends = starts.copy()
    inner = at[(at > 0) & (at < len(raw))]
    first = np.ones(len(raw), bool)  # whether a word that holds this byte would begin here
    first[1:] = space[:-1]
    first[inner] = True
    starts &= first
    last = np.ones(len(raw), bool)
    last[:-1] = space[1:]
    last[inner - 1] = True
    ends &= last
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:-8])
    return Words(range_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, at), raw, at, low)


def substring_hashes(words: Words, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of byte ranges (starts, ends) of the slice, such as affixes of words; each item of the list by a salt of its own."""
    return [range_hashes(words.low, a, b, salt) for salt, (a, b) in enumerate(ranges, 1)]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words on end (those over the border of two texts too)."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - n + 1, U)
    for i in range(n):
        out = out * U(PRIME) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct ``n``-word shingles; of fewer words the whole sequence is one; of none, there is none."""
    grams, out = ngrams(words.hashes, n), []
    ends = words.ends_of
    for i in range(len(ends) - 1):
        a, b = ends[i], ends[i + 1]
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(ngrams(words.hashes[a:b], int(b - a)) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out
