"""Which of very many texts (keys) a line holds, without the keys themselves.

A key is known by a 64-bit hash of its UTF-8 bytes and its length. Hashes of all windows of a
line come from prefix sums, so a window of any length costs one subtraction and one product. A
Bloom filter of bounded size (``MOST_BITS``) holds the hash of each key and that of its first
2, 4, 8, 16 or 32 bytes, the most that it has: where such a beginning may stand, the lengths of
keys that begin so are tried. The filter misses no key; what it lets through in error is found
out where the hashes are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

MOST_BITS = 28  # 32 MB
LEAST_BITS = 16
BITS_A_KEY = 64
LONGEST_START = 32
_AT_ONCE = 1 << 20  # bytes; their sums and windows take some fifty times as much
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240101).integers(1, 1 << 64, 256, dtype=np.uint64)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    told = []
    for base in (_BASE, _INVERSE):
        own = np.full(n, base, np.uint64)
        own[0] = 1
        told.append(np.cumprod(own, dtype=np.uint64))
    return told[0], told[1]


class Windows:
    """Hashes of windows of a text."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, int(len(data)).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers[: len(data)], out=self.sums[1:])

    def every(self, length: int, n: int) -> np.ndarray:
        """Those of the first ``n`` windows of a length."""
        return (self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n]

    def at(self, starts: np.ndarray, lengths) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]


def _mixed(hashes: np.ndarray, salt) -> np.ndarray:
    out = hashes ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def start_of(length: int) -> int:
    """How many bytes of a key of ``length`` bytes are its beginning."""
    return min(LONGEST_START, 1 << (length.bit_length() - 1))


def key_hashes(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the beginning, and number of bytes of each key."""
    texts = [k.encode() for k in keys]
    lengths = np.array([len(t) for t in texts], np.int64)
    whole, begun = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    low = 0
    while low < len(texts):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(lengths[low:]), _AT_ONCE, "right")))
        own = lengths[low:high]
        starts = np.concatenate([[0], np.cumsum(own)[:-1]])
        windows = Windows(np.frombuffer(b"".join(texts[low:high]), np.uint8))
        first = np.array([start_of(int(n)) for n in own], np.int64)
        whole[low:high] = _mixed(windows.at(starts, own), own)
        begun[low:high] = _mixed(windows.at(starts, first), -first)
        low = high
    return whole.view(np.int64), begun.view(np.int64), lengths


def bits_for(keys: int) -> int:
    """The size of a filter, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (keys * BITS_A_KEY).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    own, rest = hashes.view(np.uint64), np.uint64(64 - bits)
    return (own >> rest).astype(np.int64), ((own * _SECOND) >> rest).astype(np.int64)


class KeyFilter:
    """The filter, packed in bytes, and the lengths that keys have."""

    def __init__(self, bits: int, data: np.ndarray, lengths: Sequence[int]):
        self.bits, self.data = bits, data
        self.levels: dict[int, list[int]] = {}
        for n in sorted(lengths):
            self.levels.setdefault(start_of(n), []).append(n)
        self.longest = max(lengths, default=0)

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def holding(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that the filter may hold."""
        one = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.flatnonzero(self._set(one))
        return found[self._set(places(hashes[found], self.bits)[1])]

    def scan(self, texts: pa.Array) -> pa.Array:
        """Hashes of the keys that each text may hold, each once; none for null."""
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        if not len(texts) or data is None or not self.levels:
            return pa.array([[]] * len(texts), pa.list_(pa.int64()))
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)
        found = []
        for low in range(int(ends[0]), int(ends[-1]), _AT_ONCE):
            high = min(low + _AT_ONCE, int(ends[-1]))
            reach = min(high + self.longest, int(ends[-1])) - low
            windows = Windows(data[low : low + reach])
            for start, lengths in self.levels.items():
                n = min(high - low, reach - start + 1)
                if n <= 0:
                    continue
                at = self.holding(_mixed(windows.every(start, n), np.int64(-start)))
                rows = np.searchsorted(ends, at + low, "right") - 1
                room = ends[rows + 1] - low - at
                for length in lengths:
                    fits = room >= length
                    own = _mixed(windows.at(at[fits], length), np.int64(length))
                    held = self.holding(own)
                    if len(held):
                        found.append((rows[fits][held], own[held].view(np.int64)))
        if not found:
            return pa.array([[]] * len(texts), pa.list_(pa.int64()))
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(pairs[:, 1])))


def filter_pieces(hashes: Iterator[pa.RecordBatch], bits: int, piece_bits: int) -> Iterator[pa.RecordBatch]:
    """(piece, place) of the bits of (hash, start) rows."""
    for batch in hashes:
        own = [np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]
        at = np.unique(np.concatenate([p for h in own for p in places(h, bits)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array((at >> piece_bits).astype(np.int32)), pa.array((at & ((1 << piece_bits) - 1)).astype(np.int32))],
            ["piece", "place"],
        )


def packed_pieces(rows: Iterator[pa.RecordBatch], piece_bits: int) -> Iterator[pa.RecordBatch]:
    """(piece, bytes) of (piece, place) rows; a piece's rows come to one task."""
    found: dict[int, np.ndarray] = {}
    for batch in rows:
        piece, place = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        for p in np.unique(piece):
            own = found.setdefault(int(p), np.zeros(1 << (piece_bits - 3), np.uint8))
            at = place[piece == p]
            np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    told = [pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(told, ["piece", "bytes"])
