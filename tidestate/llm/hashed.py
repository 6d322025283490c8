"""Hashed word and character n-grams, and sums of weights over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row

from . import kernels as K
from .common import released, small


def char_hash(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n code points in a row."""
    x = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for i in range(n):
        x ^= points[i : len(points) - n + 1 + i]
        x *= K.SEED
        x ^= x >> K.U64(29)
    return x * K.ODD


@dataclass(frozen=True)
class Grams:
    """Which n-grams make features; each kind has 2**bits buckets of its own. words, chars: the lengths (chars in code points)."""

    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3, 4)
    bits: int = 18

    @property
    def size(self) -> int:
        return 1 << self.bits

    @property
    def dims(self) -> int:
        return self.size * (len(self.words) + len(self.chars))

    def kinds(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind the bucket of every gram, and the first and the end of each row's (grams across rows lie between)."""
        if self.words:
            w = K.Words(data, offsets, K.NON_SPACE)
            h = w.hashes()
            for n in self.words:
                g = h if n == 1 else K.window_hash(h, n)
                yield (g >> K.U64(64 - self.bits)).astype(np.int64), w.row_at[:-1], np.maximum(w.row_at[1:] - n + 1, w.row_at[:-1])
        points, at = K.code_points(data, offsets)
        for n in self.chars:
            x = char_hash(points, n)
            yield (x >> K.U64(64 - self.bits)).astype(np.int64), at[:-1], np.maximum(at[1:] - n + 1, at[:-1])

    def means(self, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum over kinds of the mean weight of a row's grams; weights are integers, so that the sums don't depend on batches."""
        out = np.zeros(len(offsets) - 1)
        for k, (bucket, a, b) in enumerate(self.kinds(data, offsets)):
            total = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(weights[k * self.size : (k + 1) * self.size][bucket], out=total[1:])
            out += (total[b] - total[np.minimum(a, b)]) / np.maximum(b - a, 1)
        return out

    def sparse(self, data: np.ndarray, offsets: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows' distinct features: where each row begins (n + 1), indices, and shares of the row's grams of that kind (or ones)."""
        rows, index, share = [], [], []
        for k, (bucket, a, b) in enumerate(self.kinds(data, offsets)):
            size = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            key, n = np.unique((np.repeat(np.arange(len(a)), size) << self.bits) | bucket[at], return_counts=True)
            r = key >> self.bits
            rows.append(r)
            index.append((key & (self.size - 1)) + k * self.size)
            share.append(n / size[r] if counts else np.ones(len(n)))
        r, i, s = map(np.concatenate, (rows, index, share))
        order = np.lexsort((i, r))
        return np.searchsorted(r[order], np.arange(len(offsets))), i[order], s[order]


def sparse_rows(column: pa.Array, grams: Grams, counts: bool = True) -> Iterator[tuple[bytes, bytes]]:
    """Each text's features as bytes (int32 indices, float32 values)."""
    data, offsets = K.buffers(column)
    for a, b in K.chunks(offsets):
        at, i, s = grams.sparse(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], counts)
        i, s = i.astype(np.int32), s.astype(np.float32)
        for j in range(b - a):
            yield i[at[j] : at[j + 1]].tobytes(), s[at[j] : at[j + 1]].tobytes()


#: Features that a fit takes at most: of the rows in order of a hash, as many as come before this number is reached.
FEATURES = 16_000_000


def fitted(rows: DataFrame, order: list[Column], features: Callable, schema: str, train: Callable, result: str, most: int = FEATURES) -> list[Row]:
    """What train makes of the rows' features, in a task of an executor: neither texts nor features come to the driver.

    rows: (y, text), a bounded sample; order: what puts them in an order of their own. features: text column -> a pair of
    bytes (int32 indices, float32 values) of each text. schema: that of y. train: (list of y, list of pairs) -> iterator of record
    batches (result). Beyond `most` features no more rows are taken, so that long texts can't fill the task's memory.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small(whole):
                pairs = list(features(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([i for i, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], ["y", *keys, "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, pairs, n = [], [], 0
        for b in batches:
            for y, i, v in zip(*(b.column(k) for k in range(3)), strict=True):
                if n < most:
                    ys.append(y.as_py())
                    pairs.append((i.as_py(), v.as_py()))
                    n += len(pairs[-1][0]) // 4
        yield from train(ys, pairs)

    keys = [f"k{i}" for i in range(len(order))]
    kinds = ", ".join(f"{k} {rows.select(c.alias(k)).schema[0].dataType.simpleString()}" for k, c in zip(keys, order, strict=True))
    one = rows.select("y", "text", *(c.alias(k) for c, k in zip(order, keys, strict=True))).mapInArrow(released(featurise), f"y {schema}, {kinds}, i binary, v binary")
    return one.repartition(1).sortWithinPartitions(*keys, "y", "i", "v").select("y", "i", "v").mapInArrow(released(run), result).collect()


class Rows:
    """Sparse rows, in blocks of some hundred thousand features so that no product needs a large temporary."""

    BLOCK = 400_000

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """pairs: indices (int32) and values (float32) of each row."""
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, size = [], 0
        for n, pair in enumerate(pairs):
            held.append(pair)
            size += len(pair[0]) // 4
            if size >= self.BLOCK or n == len(pairs) - 1:
                at = np.cumsum([0, *(len(i) // 4 for i, _ in held)])
                self.blocks.append((at, np.frombuffer(b"".join(i for i, _ in held), np.int32), np.frombuffer(b"".join(v for _, v in held), np.float32)))
                held, size = [], 0

    def __len__(self) -> int:
        return sum(len(at) - 1 for at, _, _ in self.blocks)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = []
        for at, index, value in self.blocks:
            total = np.zeros(len(index) + 1)
            np.cumsum(w[index] * value, out=total[1:])
            out.append(total[at[1:]] - total[at[:-1]])
        return np.concatenate(out) if out else np.zeros(0)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        """The transposed product."""
        out, done = np.zeros(dims), 0
        for at, index, value in self.blocks:
            n = len(at) - 1
            out += np.bincount(index, np.repeat(g[done : done + n], np.diff(at)) * value, dims)
            done += n
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * margin + shift) a probability, by Newton steps on smoothed targets."""
    if len(margin) == 0:
        return 1.0, 0.0
    pos, neg = (y > 0.5).sum(), (y <= 0.5).sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / scale), float(b)
