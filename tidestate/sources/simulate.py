"""Simulators: truth and observations of the standing models; series of a task move in step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import principal_sqrt
from ..functions.rand import normal, stream
from ..models import EXAMPLES, GeneralModel, Model, lorenz_step
from ..operators.particles import observation_covariances, step_covariances

SCHEMA = "series_id long, t int, x array<double>, ys array<double>"


def simulate(spark: SparkSession, name: str, series: int, steps: int, seed: int = 0) -> DataFrame:
    """series_id, t (from 1), x and ys of the model EXAMPLES[name]; t = 1 is the first state after the prior mean."""
    return simulate_like(spark.range(series).select(F.col("id").alias("series_id"), F.lit(steps).alias("steps")), name, seed)


def simulate_like(lengths: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """simulate for each series_id of lengths (series_id, steps)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All series of a group in step, the longest first, so that those still running are a prefix."""
        group = group.sort_values(["steps", "series_id"], ascending=[False, True], kind="stable")
        out = [_in_step(EXAMPLES[name](), name, seed, group["series_id"].to_numpy()[a : a + IN_STEP], group["steps"].to_numpy()[a : a + IN_STEP].astype(int)) for a in range(0, len(group), IN_STEP)]
        return pd.concat(out, ignore_index=True)

    return lengths.withColumn("batch", _batch(lengths)).groupBy("batch").applyInPandas(run, SCHEMA)


#: Series that are simulated in step, and the least number of groups that series are dealt to.
IN_STEP, GROUPS = 2000, 256


def _batch(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64("series_id"), F.lit(max(GROUPS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _in_step(model: Model | GeneralModel, name: str, seed: int, ids: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    """Series of falling lengths; each draws from a generator of its own."""
    steps, dq, dr = int(lengths[0]), len(model.Q), len(model.R)
    q, r = np.zeros((len(ids), steps, dq)), np.zeros((len(ids), steps, dr))
    for s, (i, k) in enumerate(zip(ids, lengths, strict=True)):
        z = stream(seed, name, int(i)).standard_normal((k, dq + dr))
        q[s, :k], r[s, :k] = z[:, :dq], z[:, dq:]
    q, r = q @ principal_sqrt(model.Q).T, r @ principal_sqrt(model.R).T
    x = np.repeat(np.atleast_2d(np.asarray(model.m0, float)), len(ids), 0)
    xs, ys = np.zeros((len(ids), steps, model.dim)), np.zeros((len(ids), steps, dr)) if steps == 0 else None
    for t in range(steps):
        n = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t
        if isinstance(model, GeneralModel):
            x = model.f(x[:n], q[:n, t])
            y = model.g(x, r[:n, t])
        else:
            x = model.step(x[:n]) + q[:n, t]
            y = model.observe(x) + r[:n, t]
        ys = np.zeros((len(ids), steps, y.shape[1])) if ys is None else ys
        xs[:n, t], ys[:n, t] = x, y
    live = np.arange(steps)[None] < lengths[:, None]
    t = np.broadcast_to(np.arange(1, steps + 1), live.shape)[live]
    return pd.DataFrame({"series_id": np.repeat(ids, lengths), "t": t, "x": list(xs[live]), "ys": list(ys[live])})


def deviation(mean_square: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many standard errors a mean square of n standard normals lies from 1. Mean squares are skewed; their cube roots hardly are (Wilson and Hilferty)."""
    return (np.cbrt(mean_square) - (1 - 2 / (9 * n))) / np.sqrt(2 / (9 * n))


def fits(simulated: DataFrame, name: str, width: float = 5.0) -> DataFrame:
    """series_id, steps, and whether the mean squares of states' and observations' residuals, whitened by the model's noises, lie within `width` standard errors of 1."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All series of a group at once."""
        model, group = EXAMPLES[name](), group.sort_values(["series_id", "t"])
        ids, first, n = np.unique(group["series_id"].to_numpy(), return_index=True, return_counts=True)
        x, y = np.stack(group["x"].to_list()), np.stack(group["ys"].to_list())
        before = np.concatenate([np.atleast_2d(model.m0), x[:-1]])
        before[first] = model.m0
        if isinstance(model, GeneralModel):
            none_q, none_r = np.zeros((len(x), len(model.Q))), np.zeros((len(x), len(model.R)))
            pairs = (x - model.f(before, none_q), step_covariances(model, before)), (y - model.g(x, none_r), observation_covariances(model, x, y.shape[1]))
        else:
            pairs = (x - model.step(before), np.broadcast_to(model.Q, (len(x), *model.Q.shape))), (y - model.observe(x), np.broadcast_to(model.R, (len(x), *model.R.shape)))
        near = []
        for e, c in pairs:
            squares = np.einsum("ni,ni->n", e, np.linalg.solve(c, e[..., None])[..., 0])
            size = n * e.shape[1]
            near.append(np.abs(deviation(np.add.reduceat(squares, first) / size, size)) < width)
        return pd.DataFrame({"series_id": ids, "steps": n, "state_fits": near[0], "observation_fits": near[1]})

    return simulated.withColumn("batch", _batch(simulated)).groupBy("batch").applyInPandas(run, "series_id long, steps long, state_fits boolean, observation_fits boolean")


def lorenz_fits(spark: SparkSession, series: int, steps: int, dt: float = 0.05, diffusion: float = 3.0, seed: int = 0) -> DataFrame:
    """series_id, parts and whether the increments of the Lorenz SDE's parts of a step, less their drift, have variance diffusion**2 times their time."""

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        path = lorenz_parts(steps, dt, diffusion, stream(seed, "lorenz", int(key[0])))
        h = dt / PARTS
        slope = np.concatenate([(lorenz_step(p[None], 1e-6, 1) - p) / 1e-6 for p in path[:-1]])
        e = (np.diff(path, axis=0) - h * slope) / (diffusion * np.sqrt(h))
        return pd.DataFrame({"series_id": [key[0]], "parts": [len(e)], "noise_fits": [bool(abs((e * e).mean() - 1) < 5 * np.sqrt(2 / e.size))]})

    return spark.range(series).withColumnRenamed("id", "series_id").groupBy("series_id").applyInPandas(run, "series_id long, parts long, noise_fits boolean")


#: Parts of a step of the Lorenz SDE.
PARTS = 10


def lorenz_parts(steps: int, dt: float, diffusion: float, rng: np.random.Generator) -> np.ndarray:
    """The Lorenz SDE by Euler-Maruyama, PARTS states a step and the first: (steps * PARTS + 1, 3)."""
    x, h = np.array([[1.0, 0.0, 0.0]]), dt / PARTS
    out = [x[0]]
    for _ in range(steps * PARTS):
        slope = (lorenz_step(x, 1e-6, 1) - x) / 1e-6
        x = x + h * slope + diffusion * np.sqrt(h) * rng.standard_normal((1, 3))
        out.append(x[0])
    return np.array(out)


def lorenz_paths(spark: SparkSession, series: int, steps: int = 200, dt: float = 0.05, diffusion: float = 3.0, seed: int = 0) -> DataFrame:
    """series_id, t and x of the Lorenz system: by Euler-Maruyama in ten parts a step, or by Runge-Kutta alone if diffusion is 0."""

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        if diffusion:
            out = list(lorenz_parts(steps, dt, diffusion, stream(seed, "lorenz", int(key[0])))[::PARTS])
        else:
            x = np.array([[1.0, 0.0, 0.0]])
            out = [x[0], *((x := lorenz_step(x, dt))[0] for _ in range(steps))]
        return pd.DataFrame({"series_id": key[0], "t": np.arange(steps + 1), "x": out})

    return spark.range(series).withColumnRenamed("id", "series_id").groupBy("series_id").applyInPandas(run, "series_id long, t int, x array<double>")


def constant_velocity(spark: SparkSession, series: int, steps: int, q: float = 1.0, r: float = 100.0, seed: int = 0) -> DataFrame:
    """series_id, t, x1, x2 and y in Catalyst alone: positions and velocities as running sums of keyed normals."""
    from pyspark.sql import Window

    ids = spark.range(series).select(F.col("id").alias("series_id"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("t"))
    so_far = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    v = ids.withColumn("x2", F.sum(F.lit(q**0.5) * normal(seed, "v", F.col("series_id"), F.col("t"))).over(so_far))
    x = v.withColumn("x1", F.coalesce(F.sum("x2").over(before), F.lit(0.0)) + F.sum(F.lit(0.1) * normal(seed, "x", F.col("series_id"), F.col("t"))).over(so_far))
    return x.select("series_id", "t", "x1", "x2", (F.col("x1") + F.lit(r**0.5) * normal(seed, "y", F.col("series_id"), F.col("t"))).alias("y"))
