"""Online filtering: a stateful Structured Streaming operator keeps each series' state between micro-batches.

Rows have series_id, ts and y. Within a micro-batch a series' rows are taken in order of ts, those of one ts in order of y (null last); rows before the
series' last ts are late: they are left out and counted, the count being kept in the state and shown with the next row. Rows of the last ts
itself are not late. A null y predicts only. State is a few numbers a series
(n particles for the particle filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rand import stream
from ..models import Model
from ..operators import gaussian, particles

OUT = "series_id long, ts timestamp, mean double, var double, loglik double, late long"


def _ordered(batches: Iterator[pd.DataFrame], last: float) -> tuple[pd.DataFrame, int]:
    rows = pd.concat(list(batches)).sort_values(["ts", "y"], kind="stable", na_position="last")
    ok = rows["ts"].astype("int64") >= last
    return rows[ok], int((~ok).sum())


def kalman(rows: DataFrame, model: Model, watermark: str | None = None) -> DataFrame:
    """Filters a stream with a linear model of one observed value; gives the first state after each row."""
    d = model.dim

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, p, last, late = model.m0.copy(), np.asarray(model.P0, float).copy(), int(np.iinfo(np.int64).min), 0
        if state.exists:
            flat, last, late = state.get
            m, p = np.array(flat[:d]), np.array(flat[d:]).reshape(d, d)
        new, more = _ordered(batches, last)
        out = []
        for ts, y in zip(new["ts"], new["y"], strict=True):
            ms, ps, ll = gaussian.run(model.with_(m0=m, P0=p), np.array([[np.nan if y is None else y]], float))
            m, p = ms[-1], ps[-1]
            out.append((key[0], ts, m[0], p[0, 0], ll[-1], late + more))
        if len(new):
            last = int(new["ts"].astype("int64").iloc[-1])
        state.update(([*m.tolist(), *p.ravel().tolist()], last, late + more))
        yield pd.DataFrame(out, columns=["series_id", "ts", "mean", "var", "loglik", "late"])

    if watermark:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy("series_id").applyInPandasWithState(run, OUT, "flat array<double>, last long, late long", "append", GroupStateTimeout.NoTimeout)


def bootstrap(rows: DataFrame, model: Model, n: int = 200, seed: int = 0) -> DataFrame:
    """As kalman, by a bootstrap particle filter of n particles; draws are keyed by series and row number."""
    d = model.dim

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            flat, last, late, t = state.get
            x = np.array(flat).reshape(n, d)
        else:
            x, last, late, t = particles.prior(model, n, stream(seed, key[0], 0)), int(np.iinfo(np.int64).min), 0, 0
        new, more = _ordered(batches, last)
        out = []
        for ts, y in zip(new["ts"], new["y"], strict=True):
            t += 1
            s = particles.bootstrap(model, x, np.array([np.nan if y is None else y], float), stream(seed, key[0], t))
            x = s.resampled
            out.append((key[0], ts, s.mean[0], s.spread[0, 0], s.loglik, late + more))
        if len(new):
            last = int(new["ts"].astype("int64").iloc[-1])
        state.update((x.ravel().tolist(), last, late + more, t))
        yield pd.DataFrame(out, columns=["series_id", "ts", "mean", "var", "loglik", "late"])

    return rows.groupBy("series_id").applyInPandasWithState(run, OUT, "flat array<double>, last long, late long, t long", "append", GroupStateTimeout.NoTimeout)
