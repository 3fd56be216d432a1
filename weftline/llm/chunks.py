"""A store of the ids of text chunks, looked up by hash and told apart by their bytes, many at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import U, lane, range_hashes

#: Unicode white space of two and three UTF-8 bytes: first byte, and all that may follow it. Fixed values.
WIDE_SPACE = (
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\x80", b"\xe2\x80\x81", b"\xe2\x80\x82", b"\xe2\x80\x83",
    b"\xe2\x80\x84", b"\xe2\x80\x85", b"\xe2\x80\x86", b"\xe2\x80\x87", b"\xe2\x80\x88", b"\xe2\x80\x89", b"\xe2\x80\x8a",
    b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)
_WIDE = {n: {int.from_bytes(x, "big") for x in WIDE_SPACE if len(x) == n} for n in (2, 3)}
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def space_mask(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to Unicode white space."""
    space = _ASCII_SPACE[raw]
    for n, firsts in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        for first in firsts:
            at = np.flatnonzero(raw[: len(raw) - n + 1] == first)
            if not len(at):
                continue
            value = raw[at].astype(np.int64)
            for k in range(1, n):
                value = value << 8 | raw[at + k]
            for p in at[np.isin(value, list(_WIDE[n]))]:
                space[p : p + n] = True
    return space


def runs_between_breaks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between spaces, line ends and texts' ends."""
    held = ~_BREAK[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = at[(at > 0) & (at < len(raw))]
    first, last = np.ones(len(raw), bool), np.ones(len(raw), bool)
    first[1:], last[:-1] = ~held[:-1], ~held[1:]
    first[inner], last[inner - 1] = True, True
    return np.flatnonzero(held & first), np.flatnonzero(held & last) + 1


def spaced_chunks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of byte-level BPE's chunks, which cover the texts: a run without space takes along one
    space before it; of other white space the last character before a run stands alone."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = space_mask(raw)
    opens = np.zeros(len(raw), bool)  # the first byte of a text
    opens[at[:-1][at[:-1] < len(raw)]] = True
    turn = np.zeros(len(raw), bool)
    turn[1:] = space[1:] != space[:-1]
    turn &= ~opens
    after = np.flatnonzero(turn & ~space)  # runs that follow white space of their text
    back = np.where(raw[after - 1] < 0x80, 1, np.where(raw[np.maximum(after - 2, 0)] == 0xC2, 2, 3))
    begins = opens
    begins |= turn & space
    begins[after - back] = True
    begins[after[raw[after - back] != 32]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(raw))


class ChunkStore:
    """Open-addressed table from chunks to runs of ids in one pool; when half full, it starts anew.

    A chunk is found by a hash and then held against the chunk's own bytes: the first 16 as two lanes, longer ones whole. So
    a text that was made to share another's hash gets its own ids all the same.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], kind: str, bits: int = 21) -> None:
        self.learn, self.kind, self.bits = learn, np.dtype(kind), bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.keys, self.begin, self.size = np.zeros(n, U), np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.lanes, self.lengths, self.whole = np.zeros((n, 2), U), np.zeros(n, np.int32), {}
        self.pool, self.used, self.held = np.zeros(1 << 20, self.kind), 0, 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        mask = U((1 << self.bits) - 1)
        out = np.full(len(hashes), -1, np.int64)
        open_, at = np.arange(len(hashes)), hashes & mask
        while len(open_):
            found = self.keys[at.view(np.int64)]
            hit = found == hashes[open_]
            out[open_[hit]] = at[hit].view(np.int64)
            go = ~hit & (found != 0)
            open_, at = open_[go], (at[go] + U(1)) & mask
        return out

    def _pooled(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool holds runs of ids that are added to it, and their sizes."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(flat), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        begins = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else sizes
        self.used += len(flat)
        return begins, sizes

    def _insert(self, hashes: np.ndarray, ids: list[bytes], lanes: np.ndarray, lengths: np.ndarray, chunks: list[bytes]) -> None:
        begins, sizes = self._pooled(ids)
        self.held += len(ids)
        mask = U((1 << self.bits) - 1)
        open_, at = np.arange(len(hashes)), hashes & mask
        while len(open_):
            free = self.keys[at.view(np.int64)] == 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            slot, which = at[take].view(np.int64), open_[take]
            self.keys[slot], self.begin[slot], self.size[slot] = hashes[which], begins[which], sizes[which]
            self.lanes[slot], self.lengths[slot] = lanes[which], lengths[which]
            for i in np.flatnonzero(lengths[which] > 16).tolist():
                self.whole[int(slot[i])] = chunks[which[i]]
            left = np.ones(len(open_), bool)
            left[take] = False
            open_, at = open_[left], at[left]
            at = np.where(self.keys[at.view(np.int64)] != 0, (at + U(1)) & mask, at)

    def ids(self, raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids on end, and how many each text has."""
        wide = np.zeros(len(raw) + 16, np.uint8)
        wide[: len(raw)] = raw
        hashes, lengths = range_hashes(wide, starts, ends) | U(1), ends - starts
        slots = self._slots(hashes)
        lanes = np.stack([lane(wide, starts, lengths, 0), np.where(lengths > 8, lane(wide, starts, np.maximum(lengths, 8), 1), U(0))], axis=1) if len(starts) else np.zeros((0, 2), U)
        data = None
        if len(missing := np.flatnonzero(slots < 0)):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if self.held + len(fresh) > 1 << self.bits - 1:
                self.clear()
                fresh, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
                while len(fresh) > 1 << self.bits - 1:
                    self.bits += 1
                    self.clear()
            pick = missing[first]
            data = raw.tobytes()
            chunks = [data[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
            self._insert(fresh, self.learn([c.decode() for c in chunks]), lanes[pick], lengths[pick], chunks)
            slots = self._slots(hashes)
        begin, sizes = self.begin[slots], self.size[slots].astype(np.int64)
        other = (self.lengths[slots] != lengths) | (self.lanes[slots] != lanes).any(axis=1)
        for i in np.flatnonzero((lengths > 16) & ~other).tolist():
            data = data or raw.tobytes()
            other[i] = self.whole[int(slots[i])] != data[starts[i] : ends[i]]
        if other.any():  # another chunk's hash: worked out alone, and not kept
            at_ = np.flatnonzero(other)
            data = data or raw.tobytes()
            begin[at_], sizes[at_] = self._pooled(self.learn([data[a:b].decode() for a, b in zip(starts[at_].tolist(), ends[at_].tolist(), strict=True)]))
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.pool[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1])]
        return flat, np.diff(before[np.searchsorted(starts, at)])
