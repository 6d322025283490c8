"""Quality rules: fixed counts per document, and a hashed n-gram logistic regression fitted to labelled rows.

The regression reads word 1- and 2-grams and character 3- and 4-grams, each kind hashed to
2**18 buckets; a feature's value is its share of the text's grams of that kind. Characters are code points. It is fitted by
AdaGrad with an L2 penalty to at most SAMPLE labelled rows (those of the smallest hash of doc_id; hashed.FEATURES features at most),
calibrated by Platt's method on a fifth of them, and scored in Arrow batches against KEEP.

Defined results. A null text is empty; an empty text has zero counts and fails the base rule of
20 words. Repeated rows give repeated rows. With no labelled row, or labels of one kind only, the
verdict rests on the base rule alone (score 1). An empty table gives an empty result. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import released
from .hashed import Grams, Rows, fitted, platt, sigmoid, sparse_rows

#: Labelled rows that the regression is fitted to, at most.
SAMPLE = 2000
#: Documents whose probability of quality 1 is below this are rejected.
KEEP = 0.5
GRAMS = Grams()
SYMBOLS = K.lut(b"#*$%&|<>")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row, one array each."""
    w = K.Words(data, offsets, K.NON_SPACE)
    n = len(offsets) - 1
    out = {"n_words": w.count, "word_chars": K.per_row(K.NON_SPACE[data] & K.chars(data), offsets), "n_symbols": K.per_row(SYMBOLS[data], offsets)}
    # lines: from the start of each row with text, or from behind a \n that isn't its row's last byte
    row = np.arange(n, dtype=np.uint64)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[~np.isin(breaks + 1, offsets)] + 1]))
    of = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.searchsorted(breaks, begin), len(breaks))
    end = np.where(end < len(breaks), np.append(breaks, len(data))[end], len(data))
    end = np.minimum(end, offsets[np.minimum(of + 1, n)]) if n else end
    has = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end, of = begin[has], end[has], of[has]
    key = K.join(K.range_hash(data, begin, end), K.mix(row[of] + K.U64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(of[again], minlength=n)
    starts = K.window_starts(w.row_at, 8)
    h = K.window_hash(w.hashes(), 8)
    key = K.join(h[starts], K.mix(w.row[starts].astype(np.uint64) + K.U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out["n_repeat_words"] = K.per_row(K.covered(starts[twice], 8, len(w.start)), w.row_at)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, l2: float = 1e-5, rounds: int = 60) -> dict | None:
    """The fitted and calibrated regression, or None without labels of both kinds.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad, others ignored).
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def train(ys: list, pairs: list) -> Iterator[pa.RecordBatch]:
        y = np.array(ys, float)
        if len(set(ys)) < 2:
            return
        aside = np.arange(len(y)) % 5 == 4
        a, b = (Rows([r for r, s in zip(pairs, aside, strict=True) if s == kind]) for kind in (False, True))
        pairs.clear()
        w, bias = regression(a, y[~aside], GRAMS.dims, l2, rounds)
        slope, shift = platt(b.dot(w) + bias, y[aside])
        fixed = np.round(w * (1 << 20)).astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([fixed], pa.binary()), *(pa.array([float(x)]) for x in (bias, slope, shift))], ["w", "bias", "slope", "shift"])

    got = fitted(rows.withColumnRenamed("quality", "y"), [F.xxhash64("doc_id"), F.col("doc_id")], lambda c: sparse_rows(c, GRAMS), "int", train, "w binary, bias double, slope double, shift double")
    return {"w": np.frombuffer(got[0]["w"], "<i4"), **{k: got[0][k] for k in ("bias", "slope", "shift")}} if got else None


def regression(x: Rows, y: np.ndarray, dims: int, l2: float = 1e-5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression by AdaGrad on all rows at once."""
    w, g2, bias, b2 = np.zeros(dims), np.full(dims, 1e-12), 0.0, 1e-12
    for _ in range(rounds):
        d = (sigmoid(x.dot(w) + bias) - y) / max(len(x), 1)
        g = x.back(d, dims) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        b2 += d.sum() ** 2
        bias -= 0.2 * d.sum() / np.sqrt(b2)
    return w, bias


def assess(docs: DataFrame, model: dict | None, keep: float = KEEP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of each document of docs (doc_id, text), and its columns named in carry."""
    schema = ", ".join([SCHEMA, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])
    cast = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 integers, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                c = base_counts(d, o)
                p = np.ones(b - a)
                if m is not None:
                    margin = GRAMS.means(d, o, m["w"]) / (1 << 20) + m["bias"]
                    p = np.round(sigmoid(m["slope"] * margin + m["shift"]), 6)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                cols = [batch.column(0).slice(a, b - a), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p), *(batch.column(x).slice(a, b - a) for x in carry)]
                yield pa.RecordBatch.from_arrays(cols, [*(x.split()[0] for x in SCHEMA.split(", ")), *carry])

    return docs.select("doc_id", "text", *(c for c in carry if c != "text")).mapInArrow(released(score), schema)


def quality_rules(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fit on labelled rows of labelled_docs (docs if not given) and assess docs."""
    return assess(docs, fit(docs if labelled_docs is None else labelled_docs, labels), carry=carry)
