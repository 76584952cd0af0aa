"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Both word definitions in use are decided by single bytes: every byte of a character
beyond ASCII belongs to a word. A slice of texts is handled as one byte array, so the
cost per word is a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between blanks: [^\x20\x09-\x0D]+
NON_BLANK = np.ones(256, dtype=bool)
NON_BLANK[9:14] = NON_BLANK[32] = False

SLICE_BYTES = 4 << 20  # text bytes handled at once; only memory depends on it
_BLOCK = 1 << 20
_U = np.uint64
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * _BLOCK)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """The words of a slice of texts.

    ``data`` are the bytes (A-Z lower-cased if asked), ``starts``/``ends`` the words'
    places in them, ``first[d]:first[d + 1]`` the words of text ``d``.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = np.empty(len(self.data) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = kind[self.data]
        begin = inside[1:-1] & ~inside[:-2]
        finish = inside[1:-1] & ~inside[2:]
        lengths = np.diff(self.offsets)
        full = self.offsets[:-1][lengths > 0]
        begin[full] = inside[1:-1][full]
        last = self.offsets[1:][lengths > 0] - 1
        finish[last] = inside[1:-1][last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, word: int) -> str:
        return self.data[self.starts[word] : self.ends[word]].tobytes().decode("utf-8", "replace")

    def span(self, begin: int, end: int) -> list[str]:
        return [self.text(i) for i in range(begin, end)]

    def doc_end(self) -> np.ndarray:
        """For each word, the number of the word after its text's last."""
        return np.repeat(self.first[1:], self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit number a word; the same words give the same numbers everywhere."""
        out = np.empty(len(self), dtype=np.uint64)
        i = 0
        while i < len(self):  # a block of bytes at a time, a longer word alone
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + _BLOCK)))
            low, high = self.starts[i], self.ends[j - 1]
            up, down = _POWERS.get(high - low + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * up[: high - low], out=sums[1:])
            begin, end = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mix((sums[end] - sums[begin]) * down[begin])
            i = j
        return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, of texts put end to end (so some cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * _ODD % (1 << 64)
        out += hashes[i : i + n] * _U(factor)
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each window of ``w``, by doubling the width."""
    if len(values) < w:
        return values[:0]
    out, width = values, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < w:
        step = w - width
        out = np.minimum(out[:-step], out[step:])
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null as empty) and where each begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold about ``size`` bytes; a longer text is one piece."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(row, stop - row)
        row = stop
