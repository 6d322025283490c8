"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 2-, 3- and 4-grams of the code points of the lower-cased (A-Z) text, hashed to 2**16 buckets; a value is
the gram's share of the text times its inverse document frequency, counted over all documents
that may be learned from. The regression is fitted by follow-the-regularised-leader (proximal, per
coordinate, L1 and L2) to at most SAMPLE documents (hashed.FEATURES features at most), about as many of each language, in a task of an executor, and a
temperature fitted on a fifth of them turns its scores into probabilities.

Defined results. A null text, or one without a letter (Unicode category L), is `und` with score 0, and so is
everything if there is nothing to learn from. Documents of null text or lang are never learned
from; lang, source and doc_id are no inputs of a prediction. Repeated rows give repeated rows (each
is counted). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold, released
from .hashed import char_hash, fitted

BITS = 16
DIMS = 1 << BITS
LENGTHS = (2, 3, 4)
#: Documents that the regression is fitted to, at most.
SAMPLE = 3000
#: FTRL: learning rate and its offset, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-3, 1e-4, 3
#: Values are multiplied by this, so that the penalties act on numbers of about 1.
SCALE = 100.0
LETTERS = K.lut(bytes([*range(65, 91), *range(97, 123)]))


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of the grams of each length, by first code point."""
    return [(char_hash(points, n) >> K.U64(64 - BITS)).astype(np.int64) for n in LENGTHS]


def row_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """All gram buckets of each row of text."""
    points, at = K.code_points(K.LOWER[data], offsets)
    per = gram_buckets(points)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(LENGTHS, per, strict=True)])


def counted(column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Each text's distinct buckets and how often it has them, as bytes."""
    data, offsets = K.buffers(column)
    for a, b in K.chunks(offsets, K.CHUNK >> 1):
        for g in row_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            n = np.bincount(g, minlength=DIMS)
            i = np.flatnonzero(n)
            yield i.astype("<i4").tobytes(), n[i].astype("<f4").tobytes()


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of docs (text) each bucket occurs, and the number of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, seen = np.zeros(DIMS, np.int64), 0, np.zeros(DIMS, bool)
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for a, b in K.chunks(offsets, K.CHUNK >> 1):
                for g in row_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    seen[:] = False
                    seen[g] = True
                    total += seen
            rows += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    got = docs.select("text").mapInArrow(released(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**16 + 1 rows
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(DIMS, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, classes) and biases by FTRL-proximal, row after row."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for (i, v), c in zip(rows, y, strict=True):
            w = weights(i)
            g = softmax(v @ w)
            g[c] -= 1
            g = v[:, None] * g
            was = n[i]
            now = was + g * g
            z[i] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[i] = now
    w = weights(slice(None))
    return w[:DIMS], w[DIMS]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean() + 1e-3 * t * t
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> dict | None:
    """The fitted model, from the text and lang of the rows of docs that may_learn holds for."""
    known = docs.where(may_learn).where("text is not null and lang is not null").select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not per:
        return None
    df, n = document_frequency(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    # a hash of doc_id below a bound of each language's own picks about sample / languages rows of each
    parts, each = 1 << 20, max(1, sample // len(per))
    bound = F.element_at(F.create_map(*[F.lit(x) for k, v in per.items() for x in (k, max(1, min(parts, parts * each // v)))]), F.col("lang"))
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id"), F.xxhash64("text")]
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < bound).orderBy(*order).limit(sample)

    def train(ys: list, pairs: list) -> Iterator[pa.RecordBatch]:
        langs = sorted(set(ys))
        if not langs:
            return
        rows = []
        for i, c in pairs:
            at, n = np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(c, "<f4").astype(float)
            rows.append((np.append(at, DIMS), np.append(n / max(n.sum(), 1) * idf[at] * SCALE, 1.0)))
        y = np.array([langs.index(c) for c in ys])
        aside = np.arange(len(y)) % 5 == 4
        w, bias = ftrl([r for r, s in zip(rows, aside, strict=True) if not s], y[~aside], len(langs))
        z = np.array([v[:-1] @ w[i[:-1]] + bias for (i, v), s in zip(rows, aside, strict=True) if s]).reshape(-1, len(langs))
        fixed = np.round(w * idf[:, None] * SCALE * (1 << 20)).astype("<i8")
        cols = [pa.array([langs]), pa.array([fixed.tobytes()], pa.binary()), pa.array([bias.tolist()]), pa.array([temperature(z, y[aside])])]
        yield pa.RecordBatch.from_arrays(cols, ["langs", "w", "bias", "t"])

    got = fitted(chosen.withColumnRenamed("lang", "y"), order, counted, "string", train, "langs array<string>, w binary, bias array<double>, t double")
    if not got:
        return None
    m = got[0]
    return {"langs": m.langs, "w": np.frombuffer(m.w, "<i8").reshape(DIMS, -1), "bias": np.array(m.bias), "t": m.t}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of docs (doc_id, text)."""
    cast = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 rows of a number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets, K.CHUNK >> 1):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                lettered = K.per_row(LETTERS[d], o) > 0
                for r in np.flatnonzero(~lettered):
                    lettered[r] = any(c.isalpha() for c in d[o[r] : o[r + 1]].tobytes().decode())
                best, score = np.full(b - a, "und", object), np.zeros(b - a)
                if m is not None:
                    total = np.zeros((b - a, len(m["langs"])))
                    grams = np.zeros(b - a, np.int64)
                    points, o = K.code_points(K.LOWER[d], o)
                    for n, g in zip(LENGTHS, gram_buckets(points), strict=True):
                        end = np.maximum(o[1:] - n + 1, o[:-1])
                        start = np.minimum(o[:-1], end)
                        grams += end - start
                        for c in range(total.shape[1]):
                            s = np.zeros(len(g) + 1, np.int64)
                            np.cumsum(m["w"][:, c][g], out=s[1:])
                            at = np.minimum(end, len(g))
                            total[:, c] += s[at] - s[np.minimum(start, at)]
                    p = softmax((total / (1 << 20) / np.maximum(grams, 1)[:, None] + m["bias"]) / m["t"])
                    best = np.where(lettered, np.array(m["langs"], object)[p.argmax(1)], "und")
                    score = np.where(lettered, np.round(p.max(1), 6), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null doc_id is not held out, and never learned from."""
    return F.coalesce(fold(F.col(doc_id), 5) == 0, F.lit(False))
