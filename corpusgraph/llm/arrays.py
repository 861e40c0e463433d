"""Vectorised text primitives: words, word hashes and n-gram hashes of Arrow string columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = _powers[int(base)] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most limit bytes (one row at least) with their bytes and row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: The starting state of SipHash.
_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _sip_round(v: list[np.ndarray]) -> None:
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = _turn(v[1], 13) ^ v[0]
    v[3] = _turn(v[3], 16) ^ v[2]
    v[0] = _turn(v[0], 32)
    v[2] = v[2] + v[1]
    v[0] = v[0] + v[3]
    v[1] = _turn(v[1], 17) ^ v[2]
    v[3] = _turn(v[3], 21) ^ v[0]
    v[2] = _turn(v[2], 32)


def _sip_block(v: list[np.ndarray], block: np.ndarray) -> None:
    v[3] = v[3] ^ block
    _sip_round(v)
    v[0] = v[0] ^ block


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes of data[start:end] under a key of 64 bits: SipHash-1-3, or BLAKE2b for words of more than LONG_WORD bytes.

    Who doesn't know the key can't choose words that share a hash more often than by chance, 2**-64 a pair.
    """
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), 1 << 16):
        hi = min(lo + (1 << 16), len(start))
        at, size = start[lo:hi], end[lo:hi] - start[lo:hi]
        base = int(at[0])
        raw = np.concatenate([data[base : int(end[hi - 1])], np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        at = at - base
        full = np.where(size <= LONG_WORD, size >> 3, 0)
        state = [np.full(hi - lo, np.uint64(k ^ x)) for k, x in zip((key, ~key & (1 << 64) - 1, key, ~key & (1 << 64) - 1), _SIP, strict=True)]
        here, c = np.flatnonzero(full), 0
        while len(here):
            mine = [x[here] for x in state]
            _sip_block(mine, eight[at[here] + 8 * c])
            for x, new in zip(state, mine, strict=True):
                x[here] = new
            c += 1
            here = here[full[here] > c]
        rest = (size & 7).astype(np.uint64)
        tail = eight[at + 8 * full] & ((np.uint64(1) << (rest << np.uint64(3))) - np.uint64(1))
        _sip_block(state, tail | (size.astype(np.uint64) << np.uint64(56)))
        state[2] = state[2] ^ np.uint64(0xFF)
        for _ in range(3):
            _sip_round(state)
        out[lo:hi] = state[0] ^ state[1] ^ state[2] ^ state[3]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            body = data[start[lo + i] : end[lo + i]].tobytes()
            out[lo + i] = int.from_bytes(hashlib.blake2b(body, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


class Words:
    """The words of consecutive texts: 64-bit hashes under a key and, for text r, the range first[r]:first[r + 1].

    A key is drawn for each run of an operator and is the same for all its tasks.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: int, lower: bool = False) -> None:
        if lower:
            data = _LOWER[data]
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = word_hashes(data, self.start, self.end, key)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position on, and whether they lie in one text."""
        count = len(self.hash)
        out = np.zeros(count, np.uint64)
        for k in range(min(n, count)):
            out[: count - k] += self.hash[k:] * powers(_STEP, n)[0][k]
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(count)
        return mix(out), room >= n

    def prefix(self) -> np.ndarray:
        """Prefix sums for span()."""
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * powers(_STEP, len(self.hash) + 1)[0][: len(self.hash)], out=total[1:])
        return total

    def span(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words lo:hi, equal for equal words wherever they stand."""
        return mix((prefix[hi] - prefix[lo]) * powers(_STEP, len(self.hash) + 1)[1][lo] + (hi - lo).astype(np.uint64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i:i + n] for each i; beyond the end what is left."""
    out, width = x.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        width += step
    return out
