"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1- and 2-grams and character 4-grams (of code points), each kind hashed to 2**16 buckets. Each is
scaled by its class log-count ratio, counted over all labelled rows that may be learned from; a text's
features are then divided by the root of their number. A linear hinge-loss model is fitted to at most SAMPLE of the rows
(hashed.FEATURES features at most), in a task, by dual coordinate descent, and Platt's method on a fifth of them turns margins into probabilities.

Defined results. A null text is empty; an empty text has no features and the score of the bias. Labels
other than 0 and 1 are ignored; of several labels of one doc_id the least holds. Without labels of both kinds
every score is 0.5. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold, released
from .hashed import Grams, fitted, platt, sigmoid

GRAMS = Grams(words=(1, 2), chars=(4,), bits=16)
#: Labelled rows that the hinge-loss model is fitted to, at most.
SAMPLE = 3000
#: Probability from which a document is predicted to be of quality 1.
THRESHOLD = 0.7
#: Smoothing of the counts, cost of the hinge loss, passes over the rows.
SMOOTH, COST, PASSES = 1.0, 1.0, 20
#: Rows of labels (two numbers each) up to which they are broadcast; beyond, documents and labels are shuffled by doc_id.
BROADCAST_ROWS = 1_000_000


def distinct(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    stamp = np.zeros(GRAMS.dims, np.int64)
    data, offsets = K.buffers(column)
    for a, b in K.chunks(offsets):
        kinds = list(GRAMS.kinds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        for r in range(b - a):
            f = np.concatenate([g[x[r] : y[r]] + k * GRAMS.size for k, (g, x, y) in enumerate(kinds)])
            order = np.arange(len(f))
            stamp[f] = order
            yield f[stamp[f] == order]


def labelled(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """doc_id, text, quality of the rows to learn from."""
    y = labels.where("quality in (0, 1)").where(may_learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    small = y.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(y) if small else y, "doc_id")


def log_count_ratios(rows: DataFrame) -> np.ndarray | None:
    """Class log-count ratios of all features over rows (text, quality); None without rows of both kinds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, GRAMS.dims), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for f, q in zip(distinct(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                total[q, f] += 1
                n[q] += 1
        at = np.flatnonzero(total.any(0))
        cols = [np.append(at, -1), np.append(total[0, at], n[0]), np.append(total[1, at], n[1])]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2])], ["f", "bad", "good"])

    got = rows.select("text", "quality").mapInArrow(released(count), "f int, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # at most a row a bucket
    f, bad, good = (got[c].to_numpy() for c in ("f", "bad", "good"))
    if not (bad[f < 0].sum() and good[f < 0].sum()):
        return None
    p, q = np.full(GRAMS.dims, SMOOTH), np.full(GRAMS.dims, SMOOTH)
    p[f[f >= 0]] += good[f >= 0]
    q[f[f >= 0]] += bad[f >= 0]
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over the scaled indicators and a bias of the linear hinge-loss model. y: -1 or 1."""
    w, bias = np.zeros(GRAMS.dims), 0.0
    x = [r[f] / np.sqrt(max(len(f), 1)) for f in rows]
    norm = [float(v @ v) + 1.0 for v in x]
    a = np.zeros(len(rows))
    top = np.full(len(rows), COST)
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(a[i] - g / norm[i], 0.0), top[i])
            if new != a[i]:
                d = (new - a[i]) * y[i]
                w[rows[i]] += d * x[i]
                bias += d
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-6:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> dict | None:
    rows = labelled(docs, labels, may_learn)
    r = log_count_ratios(rows)
    if r is None:
        return None
    few = labels.where("quality in (0, 1) and doc_id is not null").where(may_learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `sample` rows of two numbers

    def train(ys: list, pairs: list) -> Iterator[pa.RecordBatch]:
        x, y = [np.frombuffer(f, np.int32) for f, _ in pairs], np.array([2 * q - 1 for q in ys])
        aside = np.arange(len(y)) % 5 == 4
        w, bias = dual_descent([f for f, s in zip(x, aside, strict=True) if not s], y[~aside], r)
        w = w * r
        margin = np.array([w[f].sum() / np.sqrt(max(len(f), 1)) + bias for f, s in zip(x, aside, strict=True) if s])
        slope, shift = platt(margin, (y[aside] > 0).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([np.round(w * (1 << 20)).astype("<i8").tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (bias, slope, shift))], ["w", "bias", "slope", "shift"])

    got = fitted(chosen.withColumnRenamed("quality", "y"), [F.xxhash64("doc_id"), F.col("doc_id")], lambda c: ((np.sort(f).astype(np.int32).tobytes(), b"") for f in distinct(c)), "int", train, "w binary, bias double, slope double, shift double")
    return {"w": np.frombuffer(got[0]["w"], "<i8"), **{k: got[0][k] for k in ("bias", "slope", "shift")}}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (the probability of quality 1) of docs (doc_id, text)."""
    cast = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if m is not None:
                margin = np.fromiter((m["w"][f].sum() / np.sqrt(max(len(f), 1)) for f in distinct(batch.column(1))), float, batch.num_rows) / (1 << 20) + m["bias"]
                p = np.round(sigmoid(m["slope"] * margin + m["shift"]), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out, and never learned from."""
    return F.coalesce(fold(F.col(doc_id), 4) == 2, F.lit(False))
