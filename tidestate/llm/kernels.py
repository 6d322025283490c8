"""Vectorised text kernels over Arrow string buffers.

Texts are handled as one UTF-8 byte buffer with row offsets, in chunks of about half a megabyte,
so that no Python string is made for a word. Words are known by a 64-bit hash of eight bytes at a
time, windows by a tree of such hashes; neither is linear (a polynomial modulo 2**64 takes some
unlike texts for one whatever its base), and long ranges are hashed by BLAKE2b.
A null text is an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
#: Ranges of more bytes are hashed by BLAKE2b.
LONG = 32
SEED = U64(0x9E3779B97F4A7C15)
ODD = U64(0xD6E8FEB86659FD93)
#: Keeps the first 0 to 8 bytes of a little-endian integer.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def lut(chars: bytes, invert: bool = False) -> np.ndarray:
    """A table of 256 flags: True for the given bytes (or for all others)."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return ~t if invert else t


#: Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = lut(b" \t\n\x0b\x0c\r", invert=True)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORDLIKE = lut(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), invert=True)
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about that many bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of some rows: byte range, row and hash of each.

    row_at[i] is the index of row i's first word; row_at[-1] is the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> None:
        if fold is not None:
            data = fold[data]
        self.data, self.offsets = data, offsets
        m = is_word[data] if len(data) else np.zeros(0, bool)
        first, last = m.copy(), m.copy()
        if len(m):
            first[1:] &= ~m[:-1]
            last[:-1] &= ~m[1:]
            inner = offsets[(offsets < len(m))]
            first[inner] = m[inner]
            inner = offsets[offsets > 0] - 1
            last[inner] = m[inner]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, offsets)
        self.row_at[-1] = len(self.start)
        self.count = np.diff(self.row_at)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return range_hash(self.data, self.start, self.end)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges are in order of start."""
    n = end - start
    out = mix(n.astype(U64) + SEED)
    if not len(out):
        return out
    cuts = (np.flatnonzero(np.diff(start // CHUNK)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(start)], strict=True):
        low, high = int(start[a]), min(int(start[b - 1]) + LONG, len(data))
        part = np.zeros(high - low + 8, np.uint8)
        part[:-8] = data[low:high]
        eight = np.ascontiguousarray(np.ndarray(len(part) - 7, "<u8", part, strides=(1,)))  # the eight bytes from each on
        at, left, h = start[a:b] - low, n[a:b], out[a:b]
        h[:] = mix(h ^ (eight.take(at) & FIRST.take(np.minimum(left, 8))))
        more = np.flatnonzero((left > 8) & (left <= LONG))
        for done in range(8, LONG, 8):
            if not len(more):
                break
            rest = left.take(more) - done
            h[more] = mix(h.take(more) ^ (eight.take(at.take(more) + done) & FIRST.take(np.minimum(rest, 8))))
            more = more[rest > 8]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] ^= U64(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a run, from those of its two parts."""
    x = a * SEED
    x ^= b
    x ^= x >> U64(32)
    x *= ODD
    x ^= x >> U64(29)
    return x


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i+k] for every i up to len(h) - k (along the last axis); callers keep windows within a row."""
    n = h.shape[-1] - k + 1
    if n <= 0:
        return np.zeros((*h.shape[:-1], 0), U64)
    out, have, power, size = None, 0, h, 1
    while True:  # power: hashes of runs of `size`, a power of two
        if k & size:
            part = power[..., have : have + n]
            out = part if out is None else join(out, part)
            have += size
        if have == k:
            return out
        power = join(power[..., :-size], power[..., size:])
        size *= 2


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of rows of UTF-8, and where each row's begin (n + 1). Of bytes that are no UTF-8, each is one."""
    if not len(data) or data.max() < 0x80:
        return data, offsets
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars(data), out=at[1:])
    at = at[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    return (points, at) if len(points) == at[-1] else (data, offsets)


def window_starts(row_at: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a window of k words of one row starts."""
    n = int(row_at[-1])
    ok = np.ones(n, bool)
    for back in range(1, k):  # the last k - 1 words of a row start none
        i = row_at[1:] - back
        ok[i[i >= row_at[:-1]]] = False
    return np.flatnonzero(ok)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Flags of n words: True within start..start + k - 1 of any start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over at[i]:at[i+1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def chars(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' bytes one after another, each followed by the byte gap; and where each begins (n + 1)."""
    size = end - start + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    out = data[np.minimum(index, len(data) - 1)] if len(data) else np.zeros(int(at[-1]), np.uint8)
    out[at[1:] - 1] = gap
    return out, at
