"""Vectorised words and shingles of whole texts (numpy, one Arrow table at a time).

A word is a run of bytes outside space and \\t..\\r. Its hash runs a mixer over lanes of eight bytes: words of up to eight bytes
with different bytes never collide, longer ones by chance alone (64 bits); words over LONG bytes are hashed by BLAKE2b. No
hash is linear in a word's bytes or in a shingle's words, so no pattern of letters or words cancels out. `wide` words have a
second, independent hash, for what must be decided on 128 bits. Equal words have equal hashes in every process.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U(0xD6E8FEB86659FD93)
#: Start values and lane multipliers of the two hashes of a word.
_STARTS, _LANES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)), (U(1), U(0x165667B19E3779F9))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def chained(state: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The state after one more word's hash: different states or hashes give different states."""
    return (state ^ (state >> U(29))) * _STEP + h


def _hashed(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """One of the two hashes of each word raw[begin : begin + size]; raw goes on for eight bytes after the last."""
    lanes = np.lib.stride_tricks.sliding_window_view(raw, 8)

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return (lanes[at].view("<u8").reshape(-1) & _MASKS[np.minimum(left, 8)]) * _LANES[which]

    h = mix(lane(begin, size) ^ (_STARTS[which] + size.astype(U) * _STEP))
    for at in range(8, LONG, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            return h
        h[more] = mix(h[more] * _STEP ^ lane(begin[more] + at, size[more] - at))
    for i in np.flatnonzero(size > LONG).tolist():
        full = hashlib.blake2b(raw[begin[i] : begin[i] + size[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(full[8 * which : 8 * which + 8], "little")
    return h


class Words:
    """hashes: one of each word, in order; others: a second one, of wide words; counts and first: how many words each text has,
    and its first word's index. begin and end: the words' byte ranges in data."""

    def __init__(self, texts: list[bytes], lower: bool = False, wide: bool = False):
        self.data = b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        inside = ~SPACE[raw]
        inside[-8:] = False
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = self.end - self.begin
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        stop = np.searchsorted(self.begin, ends)
        self.first = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.counts = stop - self.first
        self.hashes = _hashed(raw, self.begin, size, 0)
        self.others = _hashed(raw, self.begin, size, 1) if wide else None

    def grams(self, n: int, second: bool = False) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 of the table's words have none. Windows that run over a
        text's end are there too: take the first counts - n + 1 of each text."""
        h = self.others if second else self.hashes
        m = max(0, len(h) - n + 1)
        out = np.full(m, U(n))
        for i in range(n):
            out = chained(out, h[i : i + m])
        return mix(out)

    def short(self, i: int) -> np.ndarray:
        """The hash of text i's whole word sequence, as an array of one; none without words."""
        lo, n = self.first[i], self.counts[i]
        out = np.full(min(1, n), U(n))
        for h in self.hashes[lo : lo + n]:
            out = chained(out, h)
        return mix(out)

    def shingles(self, n: int = 5) -> list[np.ndarray]:
        """Each text's sorted distinct n-word shingles; of fewer words, the whole sequence as one."""
        g = self.grams(n)
        out = []
        for i, (lo, c) in enumerate(zip(self.first.tolist(), self.counts.tolist(), strict=True)):
            s = np.sort(g[lo : lo + c - n + 1] if c >= n else self.short(i))
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        return out


def windows(flat: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words at which a window of n words starts inside one text, and the text of each."""
    room = np.maximum(words.counts - n + 1, 0)
    of = np.repeat(np.arange(len(room)), room)
    start = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + words.first[of]
    return start, of


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        a = np.minimum(a[:-step], a[step:]) if len(a) > step else a[:0]
        done += step
    return a


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
