"""Queries that hold what is drawn at random against what is known exactly.

Random filters, smoothers and chains run over every user's events with a model whose exact answer SQL gives: a random walk seen through
noise, so that the Kalman filter and the RTS smoother are exact. Each row has the exact figures and whether the random ones
agree with them, within a few of their own standard errors; SQL says that all do. Simulators make a series for each user, as long as
the user's, whose residuals have to fit the model's noises.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions.rand import stream
from .operators import batch_chains, estimation, particles
from .operators.batch_particles import LEAST
from .plans import folds, series
from .queries import INIT as KF_INIT
from .queries import KF_SQL, QUERIES, event_rows, event_series, query, rounded, sql_1d, sql_smoother
from .sources import simulate

#: The model: noises, prior mean and variance.
WALK = (25.0, 2500.0, 50.0, 400.0)
INIT = {"m": 50.0, "p": 400.0, "ll": 0.0}
EXACT = sql_1d("k.m", "k.p + 25.0", "1.0", "mp", m0=50.0, p0=400.0, q_r="2500.0")
LAST = "(SELECT *, max(t) OVER (PARTITION BY series_id) AS tt FROM k) WHERE t = tt"
SMOOTH = sql_smoother(EXACT, "k.m", "1.0", "25.0")
#: Effective particles that a filter has at each step, a backward smoother of each smoothed state, a path smoother of lines from the first step to the last, and a chain's filter.
FILTER_LEAST, SMOOTHER_LEAST, LINES_LEAST, CHAIN_LEAST = LEAST, 100.0, 20.0, 6.0


def walk() -> models.Model:
    return models.random_walk(*WALK)


def exact(spark: SparkSession, d: str) -> DataFrame:
    """series_id, and of the exact filter the states by step and the states smoothed."""
    return folds.states(event_series(spark, d), INIT, folds.kalman_1d(q=25.0, r=2500.0))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    return folds.scan(event_series(spark, d), INIT, folds.kalman_1d(q=25.0, r=2500.0)).select("series_id", "t", "m", "p", "ll")


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return folds.smooth_states(exact(spark, d), lambda x: x, lambda x: F.lit(1.0), 25.0).select("series_id", "t", "ms", "ps")


def off(estimate: str, mean: str, var: str) -> Column:
    """Mean absolute error of an estimate in standard deviations of the exact distribution. (Events are no random walk: a few are far off, where particles are few.)"""
    return F.avg(F.abs(F.col(estimate) - F.col(mean)) / F.sqrt(var))


def filter_agrees(est: DataFrame, exact_rows: DataFrame, mean: float = 0.4, loglik: float | None = 3.0) -> DataFrame:
    """est: series_id, t, mean (array), loglik of each step."""
    both = exact_rows.join(est.select("series_id", "t", F.col("mean")[0].alias("e"), "loglik"), ["series_id", "t"])
    last = F.max(F.struct("t", "m", "ll"))
    out = both.groupBy("series_id").agg(F.count("*").alias("steps"), last.alias("z"), off("e", "m", "p").alias("off"), F.sum("loglik").alias("estimated"))
    cols = ["series_id", "steps", F.col("z.m").alias("last_mean"), F.col("z.ll").alias("loglik"), (F.col("off") < mean).alias("mean_agrees")]
    if loglik is not None:
        cols.append((F.abs(F.col("estimated") - F.col("z.ll")) < loglik).alias("loglik_agrees"))
    return rounded(out.select(*cols))


FILTER_SQL = f"{EXACT} SELECT series_id, CAST(t AS BIGINT) AS steps, round(m, 6) AS last_mean, round(ll, 6) AS loglik, true AS mean_agrees, true AS loglik_agrees FROM {LAST}"
FILTER_MEAN_SQL = FILTER_SQL.replace(", true AS loglik_agrees", "")


def _filters() -> None:
    for method, n in (("bootstrap", 400), ("quasi_bootstrap", 400), ("auxiliary", 400), ("sir_extended", 400), ("sir_unscented", 400), ("improved_auxiliary", 120)):

        @query(FILTER_SQL if method != "improved_auxiliary" else FILTER_MEAN_SQL, name=f"particle_{method}_agrees")
        def _filter(spark: SparkSession, d: str, method: str = method, n: int = n) -> DataFrame:
            est = series.particle_filter(event_rows(spark, d), walk(), method, n, least=FILTER_LEAST)
            return filter_agrees(est, filtered(spark, d), *((0.7, None) if method == "improved_auxiliary" else ()))

    for method in ("bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended_general"):

        @query(FILTER_SQL, name=f"particle_general_{method}_agrees")
        def _general(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            est = series.particle_filter(event_rows(spark, d), models.general_random_walk(*WALK), method, 400, least=FILTER_LEAST)
            return filter_agrees(est, filtered(spark, d))


_filters()


@query(FILTER_SQL)
def resample_move_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap steps with Metropolis-Hastings moves of the last five states."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, ys = series.matrix(g)
        steps, _ = particles.run_resample_move(walk(), ys, 400, stream("move", int(key[0])))
        return pd.DataFrame({"series_id": key[0], "t": t, "mean": [s.mean for s in steps], "loglik": [s.loglik for s in steps]})

    est = event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, t int, mean array<double>, loglik double")
    return filter_agrees(est, filtered(spark, d))


@query(f"{EXACT} SELECT series_id, CAST(t AS BIGINT) AS steps, round(ll, 6) AS loglik, true AS agrees FROM {LAST}")
def sir_loglik_agrees(spark: SparkSession, d: str) -> DataFrame:
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, ys = series.matrix(g)
        return pd.DataFrame({"series_id": [key[0]], "estimated": [estimation.sir_loglik(walk(), ys, 400, stream("sir", int(key[0])))]})

    est = event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, estimated double")
    last = folds.last(event_series(spark, d), INIT, folds.kalman_1d(q=25.0, r=2500.0))
    return rounded(last.join(est, "series_id").select("series_id", F.col("n").cast("long").alias("steps"), F.col("ll").alias("loglik"), (F.abs(F.col("estimated") - F.col("ll")) < 3).alias("agrees")))


@query(f"{KF_SQL} SELECT series_id, CAST(t AS BIGINT) AS steps, round(m, 6) AS last_mean, true AS agrees FROM {LAST}")
def series_extended_general_agrees(spark: SparkSession, d: str) -> DataFrame:
    """The extended filter for general noise, linearised by differences, is the Kalman filter on a linear model but for the differences' error."""
    est = QUERIES["series_extended_general"](spark, d).select("series_id", "t", F.col("m").alias("e"), F.col("p").alias("v"))
    rows = folds.scan(event_series(spark, d), KF_INIT, folds.kalman_1d()).select("series_id", "t", "m", "p").join(est, ["series_id", "t"])
    near = (F.abs(F.col("e") - F.col("m")) < 2e-3) & (F.abs(F.col("v") - F.col("p")) < 2e-3)
    return rows.groupBy("series_id").agg(F.count("*").alias("steps"), F.round(F.max_by("m", "t"), 6).alias("last_mean"), F.min(near).alias("agrees"))


# smoothers: means over draws against the RTS smoother

SMOOTH_ROWS = f"SELECT series_id, count(*) AS steps, min_by(ms, t) AS first_mean, true AS mean_agrees{{}} FROM ({SMOOTH}) GROUP BY series_id"


def smoother_agrees(est: DataFrame, exact_rows: DataFrame, mean: float = 0.6, spread: bool = True) -> DataFrame:
    """est: series_id, t, e and v, the mean and variance over draws. Every step of a series is held against the smoother."""
    both = exact_rows.join(est, ["series_id", "t"])
    agg = [F.count("*").alias("steps"), F.round(F.min_by("ms", "t"), 6).alias("first_mean"), (off("e", "ms", "ps") < mean).alias("mean_agrees")]
    if spread:
        agg.append(F.avg(F.col("v") / F.col("ps")).between(0.6, 1.5).alias("spread_agrees"))
    return both.groupBy("series_id").agg(*agg)


def _smoothers() -> None:
    for method in ("backward", "rejection"):

        @query(SMOOTH_ROWS.format(", true AS spread_agrees"), name=f"trajectories_{method}_agrees")
        def _draws(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            est = series.trajectory_moments(event_rows(spark, d), walk(), method, draws=150, n=300, least=SMOOTHER_LEAST)
            return smoother_agrees(est, smoothed(spark, d))

    for method in ("path", "ancestral"):  # older states come from few ancestors: so many particles that enough lines lead there

        @query(SMOOTH_ROWS.format(""), name=f"trajectories_{method}_agrees")
        def _lines(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            est = series.trajectory_moments(event_rows(spark, d), walk(), method, draws=150, n=400, least=LINES_LEAST)
            return smoother_agrees(est, smoothed(spark, d), 1.0, False)

    for kind in ("ancestor", "backward"):

        @query(SMOOTH_ROWS.format(""), name=f"particle_gibbs_{kind}_agrees")
        def _gibbs(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
            """The mean of 20 sweeps after 5, each path of a conditional particle filter."""
            est = series.gibbs_moments(event_rows(spark, d), walk(), WALK[2], 25, 5, 80, ("gibbs", kind), kind == "backward")
            return smoother_agrees(est, smoothed(spark, d), 0.8, False)


_smoothers()


@query(SMOOTH_ROWS.format(""))
def trajectories_mean_agrees(spark: SparkSession, d: str) -> DataFrame:
    paths = series.trajectories(event_rows(spark, d), walk(), "backward", draws=100, n=300, seed=1, least=SMOOTHER_LEAST)
    est = series.mean_trajectory(paths).where("i = 0").select("series_id", "t", F.col("mean").alias("e"))
    return smoother_agrees(est, smoothed(spark, d), spread=False)


# chains: every row's estimated log likelihood against the exact one of its parameters

CHAIN_STEPS, CHAIN_PARTICLES = 20, 100


def regression(a: float = 0.9) -> models.Model:
    """x' = a x + noise around 0: observations are taken less 50."""
    m = models.linear([[a]], [[1]], [[25.0]], [[2500.0]], [0.0], [[400.0]])
    return m.with_(f=lambda x, th: th["a"] * x, df=lambda x, th: np.array([[th["a"]]]), theta={"a": a})


def _chains() -> None:
    def noises(ys: np.ndarray, lengths: np.ndarray, rngs: list) -> list[list[dict]]:
        return batch_chains.noise_chain(walk(), ys, lengths, CHAIN_STEPS, rngs, sd=10.0, n=CHAIN_PARTICLES, least=CHAIN_LEAST)

    def parameters(ys: np.ndarray, lengths: np.ndarray, rngs: list) -> list[list[dict]]:
        return batch_chains.parameter_chain(regression(), ys - 50, lengths, CHAIN_STEPS, rngs, sd=0.2, n=CHAIN_PARTICLES, least=CHAIN_LEAST)

    def noises_exact(theta: dict, ys: np.ndarray) -> float:
        return estimation.kalman_loglik(models.random_walk(theta["q0"], *WALK[1:]), ys)

    def parameters_exact(theta: dict, ys: np.ndarray) -> float:
        return estimation.kalman_loglik(regression(theta["a"]), ys - 50)

    for name, chain, exactly in (("noises", noises, noises_exact), ("parameters", parameters, parameters_exact)):

        @query(f"SELECT user_id AS series_id, CAST({CHAIN_STEPS + 1} AS BIGINT) AS rows_, CAST({CHAIN_STEPS + 1 - int(0.3 * (CHAIN_STEPS + 1))} AS BIGINT) AS kept, true AS logliks_agree, true AS moves_are_marked FROM events GROUP BY user_id", name=f"pmmh_{name}_agrees")
        def _chain(spark: SparkSession, d: str, chain: Callable = chain, exactly: Callable = exactly, name: str = name) -> DataFrame:
            """Metropolis-Hastings over every user's series: parameters change where a row is marked as accepted and nowhere else; three tenths are burnt in."""

            def off(rows: list[dict], ys: np.ndarray) -> list[float]:
                known: dict[float, float] = {}
                out = []
                for r in rows:
                    value = next(iter(r["theta"].values()))
                    if value not in known:
                        known[value] = exactly(r["theta"], ys)
                    out.append(abs(r["loglik"] - known[value]))
                return out

            def marked(rows: list[dict], _: np.ndarray) -> list[bool]:
                value = [next(iter(r["theta"].values())) for r in rows]
                return [True, *((a != b) == r["accepted"] for a, b, r in zip(value, value[1:], rows[1:], strict=False))]

            rows = series.chains_in_step(event_rows(spark, d), chain, keys=("chain", name), named=False, also={"off": ("double", off), "marked": ("boolean", marked)})
            rows = rows.withColumn("kept", series.beyond(0.3).cast("long"))  # in the same pass: a filtered frame joined on would run the chains again
            return rows.groupBy("series_id").agg(F.count("*").alias("rows_"), F.sum("kept").alias("kept"), (F.max("off") < 5).alias("logliks_agree"), F.min("marked").alias("moves_are_marked"))


_chains()


@query("SELECT user_id AS series_id, c AS chain_id, CAST(9 AS BIGINT) AS rows_, 'P0_0_0,Q_0_0,R_0_0,m0_0' AS entries, true AS finite FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1)) v(c)")
def pmmh_roots_entries(spark: SparkSession, d: str) -> DataFrame:
    """Chains over prior mean and roots of all covariances, of every user: each row has every entry of each."""
    rows = series.chains_in_step(event_rows(spark, d), functools.partial(_root_chains, steps=8), 2)
    entries = F.array_join(F.array_sort(F.map_keys("theta")), ",")
    return rows.groupBy("series_id", "chain_id").agg(F.count("*").alias("rows_"), F.max(entries).alias("entries"), (F.min(F.when(F.isnan("loglik"), 0).otherwise(1)) == 1).alias("finite"))


def _root_chains(ys: np.ndarray, lengths: np.ndarray, rngs: list, steps: int) -> list[list[dict]]:
    return batch_chains.root_chain(walk(), ys, lengths, steps, rngs, n=50)


GRADIENT_SQL = sql_1d("k.m", "k.p + 1.0", "1.0", "mp", m0=50.0, p0=100.0, q_r="exp(5)")


@query(f"{GRADIENT_SQL} SELECT series_id, round(ll / t, 6) AS first, true AS climbed, true AS near_top FROM {LAST}")
def gradient_ascent_climbs(spark: SparkSession, d: str) -> DataFrame:
    """Up the mean log likelihood of each user's series in log q and log r: from the exact value at (0, 5) to a place where the gradient is small."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, ys = series.matrix(g)
        f = lambda v: estimation.kalman_loglik(models.random_walk(np.exp(v[0]), np.exp(v[1]), 50.0, 100.0), ys) / len(ys)
        x, seen = estimation.gradient_ascent(f, np.array([0.0, 5.0]), 0.5, 60)
        before, after = (np.abs(estimation.gradient(f, v)).max() for v in (np.array([0.0, 5.0]), x))
        return pd.DataFrame({"series_id": [key[0]], "first": [seen[0]], "climbed": [bool(seen[-1] > seen[0])], "near_top": [bool(after < max(0.1, before))]})

    return rounded(event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, first double, climbed boolean, near_top boolean"))


# particle Gibbs on stochastic volatility

VOLATILITY_SERIES, VOLATILITY_STEPS = 8, 200


def volatility() -> models.GeneralModel:
    return dataclasses.replace(models.stochastic_volatility(0.999, 1.0), P0=np.eye(1))


@query(f"SELECT s AS series_id, CAST({VOLATILITY_STEPS} AS BIGINT) AS steps, true AS tracks FROM range({VOLATILITY_SERIES}) r(s)")
def particle_gibbs_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Ancestor-sampling particle Gibbs on simulated log volatilities: the mean path explains most of the hidden one's variance."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        from .operators.particles import noise

        model, rng = volatility(), stream("volatility", int(key[0]))
        x, xs, ys = np.zeros((1, 1)), [], []
        for _ in range(VOLATILITY_STEPS):
            x = model.f(x, noise(model.Q, 1, rng))
            xs.append(x[0, 0])
            ys.append(model.g(x, noise(model.R, 1, rng))[0])
        paths = estimation.particle_gibbs(model, np.array(ys), np.zeros((len(ys), 1)), 60, 60, rng)[20:, :, 0]
        truth = np.array(xs)
        error = float(((paths.mean(0) - truth) ** 2).mean())
        return pd.DataFrame({"series_id": [key[0]], "steps": [len(ys)], "tracks": [bool(error < 0.5 * truth.var() and error < 4)]})

    return spark.range(VOLATILITY_SERIES).withColumnRenamed("id", "series_id").groupBy("series_id").applyInPandas(run, "series_id long, steps long, tracks boolean")


# simulators: a series for each user, as long as the user's

FITS_SQL = "SELECT user_id AS series_id, count(*) AS steps, true AS state_fits, true AS observation_fits FROM events GROUP BY user_id"


def _simulators() -> None:
    for name in models.EXAMPLES:

        @query(FITS_SQL, name=f"simulate_{name}_fits")
        def _fits(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            """Residuals of states and observations, whitened by the model's noises, have a mean square near 1."""
            lengths = event_rows(spark, d).groupBy("series_id").agg(F.count("*").cast("int").alias("steps"))
            return simulate.fits(simulate.simulate_like(lengths, name), name)


_simulators()

_H = 0.005


def _slope(x: str, y: str, z: str, k: str) -> str:
    return f"10.0 * ({y} - {x}) AS {k}x, {x} * (28.0 - {z}) - {y} AS {k}y, {x} * {y} - (8.0 / 3) * {z} AS {k}z"


LORENZ_SQL = f"""WITH RECURSIVE p(i, x, y, z) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
SELECT i + 1, x + {_H} / 6 * (ax + 2 * bx + 2 * cx + dx), y + {_H} / 6 * (ay + 2 * by_ + 2 * cy + dy), z + {_H} / 6 * (az + 2 * bz + 2 * cz + dz) FROM (
SELECT *, {_slope(f'(x + {_H} * cx)', f'(y + {_H} * cy)', f'(z + {_H} * cz)', 'd')} FROM (
SELECT *, {_slope(f'(x + {_H / 2} * bx)', f'(y + {_H / 2} * by_)', f'(z + {_H / 2} * bz)', 'c')} FROM (
SELECT *, {_slope(f'(x + {_H / 2} * ax)', f'(y + {_H / 2} * ay)', f'(z + {_H / 2} * az)', 'b').replace('AS by,', 'AS by_,')} FROM (
SELECT *, {_slope('x', 'y', 'z', 'a')} FROM p WHERE i < 1000)))))
SELECT s AS series_id, CAST(i // 10 AS INTEGER) AS t, round(x, 4) AS x1, round(y, 4) AS x2, round(z, 4) AS x3 FROM p, range(4) r(s) WHERE i % 10 = 0"""


@query(LORENZ_SQL)
def lorenz_ode_path(spark: SparkSession, d: str) -> DataFrame:
    """The Lorenz system without noise, by Runge-Kutta."""
    paths = simulate.lorenz_paths(spark, 4, 100, diffusion=0.0)
    return paths.select("series_id", "t", *[F.round(F.col("x")[i], 4).alias(f"x{i + 1}") for i in range(3)])


@query("SELECT s AS series_id, CAST(2000 AS BIGINT) AS parts, true AS noise_fits FROM range(8) r(s)")
def lorenz_sde_fits(spark: SparkSession, d: str) -> DataFrame:
    """Increments of the Lorenz SDE less its drift have the variance diffusion**2 times the time."""
    return simulate.lorenz_fits(spark, 8, 200)


@query("SELECT user_id AS series_id, count(*) AS n, true AS mean_fits, true AS variance_fits FROM events GROUP BY user_id")
def quasi_normals_fit(spark: SparkSession, d: str) -> DataFrame:
    """Normals from lattice points: their mean and variance are nearer to 0 and 1 than those of as many random draws."""
    from .functions.rand import quasi_normals

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z = quasi_normals(len(g), 2, rng=stream("qmc", int(key[0])))
        width = 3 / np.sqrt(len(g))
        return pd.DataFrame({"series_id": [key[0]], "n": [len(g)], "mean_fits": [bool((np.abs(z.mean(0)) < width).all())], "variance_fits": [bool((np.abs(z.var(0) - 1) < 1.5 * width).all())]})

    return event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, n long, mean_fits boolean, variance_fits boolean")

