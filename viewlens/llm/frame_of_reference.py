"""Patched frame-of-reference coding of integer sequences (numpy, inside tasks).

Values are taken in blocks of ``BLOCK``.  From each block its minimum is subtracted
and the rest is packed at the width that ``SHARE`` of the block's values fit into;
the bits beyond that width of all other values, the exceptions, are stored in a list
with their positions.  Where each block's packed words and exceptions start is
stored too, so any block can be read without the ones before it.

A stream is the header ``<values, words, exceptions>`` and then, as arrays: block
minima (signed 64 bit), block starts in the packed words and in the exceptions
(unsigned 32 bit), widths (unsigned 8 bit), exception positions in the block
(unsigned 8 bit), packed words (unsigned 64 bit) and high bits of the exceptions
(unsigned 64 bit), all little-endian.
"""

from __future__ import annotations

import math
import struct

import numpy as np

BLOCK = 128
# The share of a block's values that its width has to hold.
SHARE = 0.9
HEAD = struct.Struct("<QQQ")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs (one more at most for values beyond 2**53)."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, share: float = SHARE) -> bytes:
    """The stream of a sequence of 64-bit integers."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.int64)
    padded[:n], padded[n:] = values, values[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.empty(0, np.int64)
    delta = rows.astype(np.uint64) - low.astype(np.uint64)[:, None]  # modulo 2**64: right for any two 64-bit integers
    at = max(0, math.ceil(share * BLOCK) - 1)
    width = np.minimum(np.partition(_bits(delta), at, axis=1)[:, at], 64) if blocks else np.empty(0, np.uint8)
    shift = np.where(width < 64, width, 0).astype(np.uint64)[:, None]
    high = np.where(width[:, None] < 64, delta >> shift, 0).astype(np.uint64)
    out_block, out_at = np.nonzero(high)
    words_of = width.astype(np.int64) * (BLOCK // 64)
    starts = np.cumsum(words_of) - words_of
    words = np.zeros(int(words_of.sum()), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            words[starts[mine][:, None] + np.arange(w * BLOCK // 64)] = _packed(delta[mine], w)
    exceptions = np.bincount(out_block, minlength=blocks)
    return b"".join((HEAD.pack(n, len(words), len(out_at)), low.astype("<i8").tobytes(), starts.astype("<u4").tobytes(),
                     (np.cumsum(exceptions) - exceptions).astype("<u4").tobytes(), width.astype("<u1").tobytes(),
                     out_at.astype("<u1").tobytes(), words.astype("<u8").tobytes(),
                     high[out_block, out_at].astype("<u8").tobytes()))


def _packed(delta: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of each row's values, one after another in 64-bit words."""
    columns = np.ascontiguousarray(delta.T)
    if w < 64:
        columns &= np.uint64((1 << w) - 1)
    words = np.zeros((w * BLOCK // 64, len(delta)), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        words[word] |= columns[j] << np.uint64(bit)
        if bit + w > 64:
            words[word + 1] |= columns[j] >> np.uint64(64 - bit)
    return words.T


def _unpacked(words: np.ndarray, w: int) -> np.ndarray:
    rows = np.ascontiguousarray(words.T)
    columns = np.empty((BLOCK, rows.shape[1]), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        columns[j] = rows[word] >> np.uint64(bit)
        if bit + w > 64:
            columns[j] |= rows[word + 1] << np.uint64(64 - bit)
    columns &= mask
    return columns.T


class Stream:
    """A packed sequence; ``get`` reads all of it or the blocks that a range lies in."""

    def __init__(self, data: memoryview | bytes, at: int = 0):
        self.n, n_words, n_out = HEAD.unpack_from(data, at)
        self.blocks = -(-self.n // BLOCK)
        at += HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.low = take("<i8", self.blocks)
        self.word_starts, self.exception_starts = take("<u4", self.blocks), take("<u4", self.blocks)
        self.width, self.exception_at = take("<u1", self.blocks), take("<u1", n_out)
        self.words, self.high = take("<u8", n_words), take("<u8", n_out)
        self.end = at  # of the stream in ``data``

    def get(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The values from ``start`` to ``stop``."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.empty(0, np.int64)
        first, last = start // BLOCK, -(-stop // BLOCK)
        width = self.width[first:last]
        delta = np.zeros((last - first, BLOCK), np.uint64)
        for w in np.unique(width).tolist():
            if w:
                mine = np.flatnonzero(width == w)
                at = self.word_starts[first:last][mine].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)
                delta[mine] = _unpacked(self.words[at], w)
        ends = np.append(self.exception_starts, len(self.high)).astype(np.int64)
        i, j = ends[first], ends[last]
        block = np.repeat(np.arange(last - first), np.diff(ends[first:last + 1]))
        delta[block, self.exception_at[i:j]] |= self.high[i:j] << width[block].astype(np.uint64)
        values = (delta + self.low[first:last].astype(np.uint64)[:, None]).astype(np.int64).ravel()
        return values[start - first * BLOCK:stop - first * BLOCK]
