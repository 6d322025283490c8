"""Particle sets as DataFrames: every operation of a particle step in Catalyst.

A cloud has series_id, pid (0 to n - 1), x (a double; one dimension here) and log_w or w. Noise is
keyed by (seed, series_id, t, pid), so neither partitioning nor retries change a draw. A step is a projection, an
aggregate by series and a resampling; between steps the cloud is cut from its lineage by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import normal, uniform
from ..sources.tables import stored
from .series import matrix


def prior(spark: SparkSession, series: DataFrame, n: int, mean: float = 0.0, var: float = 1.0, seed: int = 0) -> DataFrame:
    """n draws of N(mean, var) for each series_id of series."""
    pids = series.select("series_id").withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pids.withColumn("x", F.lit(mean) + F.lit(var**0.5) * normal(seed, "prior", F.col("series_id"), F.col("pid")))


def propagate(cloud: DataFrame, f: Callable[[Column], Column], q: float, t: int | Column, seed: int = 0) -> DataFrame:
    return cloud.withColumn("x", f(F.col("x")) + F.lit(q**0.5) * normal(seed, t, F.col("series_id"), F.col("pid")))


def weigh(cloud: DataFrame, obs: DataFrame, g: Callable[[Column], Column], r: float) -> DataFrame:
    """Joins obs (series_id, y) and sets log_w, the log density of y (0 without one)."""
    return weighed(cloud.join(obs.select("series_id", "y"), "series_id"), g, r)


def weighed(cloud: DataFrame, g: Callable[[Column], Column], r: float) -> DataFrame:
    """log_w of a cloud that has y."""
    e = F.col("y") - g(F.col("x"))
    return cloud.withColumn("log_w", F.when(F.col("y").isNull(), 0.0).otherwise(-0.5 * (F.log(2 * F.pi() * F.lit(r)) + e * e / F.lit(r))))


def normalised(cloud: DataFrame) -> DataFrame:
    """w sums to 1 in each series; log_mean is the log of the mean weight. By log-sum-exp over one window: one exchange, and what follows by series reuses it."""
    w = Window.partitionBy("series_id")
    out = cloud.withColumn("top", F.max("log_w").over(w)).withColumn("e", F.exp(F.col("log_w") - F.col("top")))
    out = out.withColumn("total", F.sum("e").over(w)).withColumn("n_", F.count("*").over(w))
    return out.withColumn("w", F.col("e") / F.col("total")).withColumn("log_mean", F.log("total") - F.log("n_") + F.col("top")).drop("top", "e", "total", "n_")


def moments(cloud: DataFrame) -> DataFrame:
    """series_id, n, mean, var, ess and loglik of weighted clouds (w, log_mean)."""
    m = cloud.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("x")).alias("mean"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("square"), (1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max("log_mean").alias("loglik"))
    return m.select("series_id", "n", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"), "ess", "loglik")


def cumulative(cloud: DataFrame) -> DataFrame:
    """lo and hi, the particle's interval of the weights' running sum; the last hi is 1. One series a window: clouds are bounded by n."""
    w = Window.partitionBy("series_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    last = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("pid"))) == 1
    hi = F.sum("w").over(w)
    return cloud.withColumn("hi_", hi).withColumn("lo", F.col("hi_") - F.col("w")).withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi_"))).drop("hi_")


def offspring(cloud: DataFrame, method: str, t: int | Column, seed: int = 0) -> DataFrame:
    """The resampled cloud: pid (new), ancestor and x. methods: systematic, stratified, multinomial.

    Systematic positions (k + u) / n that fall into [lo, hi) are k = ceil(n lo - u) to ceil(n hi - u) - 1: a projection that
    explodes each particle into its copies, instead of a range join. Stratified positions have one uniform number a stratum; a stratum overlaps the
    intervals of its particles, which are found the same way. Multinomial draws are hashed to n cells first, so that the range
    condition is tested within a cell only.
    """
    c = cumulative(cloud)
    n = F.count("*").over(Window.partitionBy("series_id"))
    c = c.withColumn("n", n)
    if method == "systematic":
        u = uniform(seed, "resample", t, F.col("series_id"))
        first, end = F.ceil(F.col("n") * F.col("lo") - u), F.ceil(F.col("n") * F.col("hi") - u)
        c = c.withColumn("a", first.cast("int")).withColumn("b", F.least(end, F.col("n")).cast("int")).where("b > a")
        return c.select("series_id", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("pid"), F.col("pid").alias("ancestor"), "x")
    if method == "stratified":
        c = c.withColumn("k", F.explode(F.sequence(F.floor(F.col("n") * F.col("lo")).cast("int"), F.least(F.floor(F.col("n") * F.col("hi")), F.col("n") - 1).cast("int"))))
        at = (F.col("k") + uniform(seed, "resample", t, F.col("series_id"), F.col("k"))) / F.col("n")
        return c.where((at >= F.col("lo")) & (at < F.col("hi"))).select("series_id", F.col("k").alias("pid"), F.col("pid").alias("ancestor"), "x")
    if method != "multinomial":
        raise ValueError(f"no method {method}")
    draws = c.select("series_id", "n", F.col("pid").alias("slot")).withColumn("u", uniform(seed, "resample", t, F.col("series_id"), F.col("slot"))).withColumn("cell", F.floor(F.col("u") * F.col("n")).cast("int"))
    cells = c.withColumn("cell", F.explode(F.sequence(F.floor(F.col("n") * F.col("lo")).cast("int"), F.least(F.floor(F.col("n") * F.col("hi")), F.col("n") - 1).cast("int"))))
    j = draws.join(cells.select("series_id", "cell", "lo", "hi", "x", F.col("pid").alias("ancestor")), ["series_id", "cell"])
    return j.where("u >= lo and u < hi").select("series_id", F.col("slot").alias("pid"), "ancestor", "x")


def bootstrap_step(cloud: DataFrame, obs: DataFrame, f: Callable, g: Callable, q: float, r: float, t: int, seed: int = 0, method: str = "systematic") -> tuple[DataFrame, DataFrame]:
    """Weighted particles (with ancestor left to offspring) and the next, resampled cloud."""
    weighted = normalised(weigh(propagate(cloud, f, q, t, seed), obs, g, r))
    return weighted, offspring(weighted, method, t, seed)


def bootstrap_filter(spark: SparkSession, obs: DataFrame, steps: int, n: int, f: Callable, g: Callable, q: float, r: float, mean: float = 0.0, var: float = 1.0, seed: int = 0, cut: bool = True) -> DataFrame:
    """series_id, t and moments of `steps` steps over obs (series_id, t, y); series shorter than that end earlier."""
    cloud = prior(spark, obs.select("series_id").distinct(), n, mean, var, seed)
    out = None
    for t in range(1, steps + 1):
        weighted, cloud = bootstrap_step(cloud, obs.where(F.col("t") == t), f, g, q, r, t, seed)
        if cut:
            weighted = stored(weighted, "cloud")
            cloud = offspring(weighted, "systematic", t, seed)
        m = moments(weighted).select("series_id", F.lit(t).alias("t"), "n", "mean", "var", "ess", "loglik")
        out = m if out is None else out.unionByName(m)
    return out


def bootstrap_series(obs: DataFrame, n: int, f: Callable, g: Callable, q: float, r: float, mean: float = 0.0, var: float = 1.0, seed: int = 0) -> DataFrame:
    """As bootstrap_filter, but every step of every series of obs (series_id, t from 1 on, ys), one task a series.

    The noise is made by the same Columns and travels with the rows, so both filters draw the same; f and g take arrays of particles.
    """
    pids, sid = F.sequence(F.lit(0), F.lit(n - 1)), F.col("series_id")
    drawn = obs.select(
        sid,
        "t",
        "ys",
        F.when(F.col("t") == 1, F.transform(pids, lambda p: normal(seed, "prior", sid, p))).alias("z0"),
        F.transform(pids, lambda p: normal(seed, F.col("t"), sid, p)).alias("z"),
        uniform(seed, "resample", F.col("t"), sid).alias("u"),
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        t, ys = matrix(group)
        x = mean + var**0.5 * np.asarray(group["z0"].iloc[0], float)
        out = []
        for y, z, u in zip(ys[:, 0], group["z"], group["u"], strict=True):
            x = f(x) + q**0.5 * np.asarray(z, float)
            e = y - g(x)
            log_w = np.zeros(n) if np.isnan(y) else -0.5 * (np.log(2 * np.pi * r) + e * e / r)
            w = np.exp(log_w - log_w.max())
            total = w.sum()
            w /= total
            m = (w * x).sum()
            out.append((n, m, (w * x * x).sum() - m * m, 1 / (w * w).sum(), np.log(total) - np.log(n) + log_w.max()))
            hi = np.append(np.cumsum(w)[:-1], 1.0)
            x = np.repeat(x, np.diff(np.minimum(np.ceil(n * hi - u), n), prepend=0).astype(int))
        return pd.DataFrame(out, columns=["n", "mean", "var", "ess", "loglik"]).assign(series_id=key[0], t=t)[["series_id", "t", "n", "mean", "var", "ess", "loglik"]]

    return drawn.groupBy("series_id").applyInPandas(run, "series_id long, t int, n long, mean double, var double, ess double, loglik double")


def transition_mixture(before: DataFrame, now: DataFrame, f: Callable[[Column], Column], q: float) -> DataFrame:
    """series_id, pid and mix: for each particle of now (series_id, pid, x) the sum over particles of before (series_id, x, w) of w times the transition density.

    n * n densities a series by nature, n being the number of particles; they are folded over an array of the series' particles, so that no row is made for a pair.
    If both are one cloud, it is made once.
    """
    one = F.struct(f(F.col("x")).alias("m"), F.col("w"))
    density = lambda x, b: b["w"] * F.exp(-0.5 * (x - b["m"]) * (x - b["m"]) / q) / F.sqrt(2 * F.pi() * F.lit(q))
    if before is now:
        both = now.groupBy("series_id").agg(F.collect_list(one).alias("b"), F.collect_list(F.struct("pid", "x")).alias("n"))
        mixes = F.transform("n", lambda v: F.struct(v["pid"].alias("pid"), F.aggregate("b", F.lit(0.0), lambda acc, b: acc + density(v["x"], b)).alias("mix")))
        return both.select("series_id", F.inline(mixes))
    arrays = before.groupBy("series_id").agg(F.collect_list(one).alias("b"))
    return now.join(arrays, "series_id").select("series_id", "pid", F.aggregate("b", F.lit(0.0), lambda acc, b: acc + density(F.col("x"), b)).alias("mix"))


def pending(draws: DataFrame, accepted: DataFrame) -> DataFrame:
    """Draws (series_id, draw) that are not among the accepted."""
    return draws.join(accepted, ["series_id", "draw"], "left_anti")


def gather(slots: DataFrame, cloud: DataFrame) -> DataFrame:
    """slots (series_id, pid, ancestor) with the ancestor's columns of cloud."""
    return slots.join(cloud.withColumnRenamed("pid", "ancestor"), ["series_id", "ancestor"])


def energy(loglik: DataFrame) -> DataFrame:
    """series_id, t, loglik and energy, the running sum of negative log likelihoods."""
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return loglik.withColumn("energy", -F.sum("loglik").over(w))


def rmse(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """series_id and rmse of frames (series_id, t, x as array): the root of the mean squared error norm."""
    e = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    both = truth.select("series_id", "t", F.col("x").alias("a")).join(estimate.select("series_id", "t", F.col("x").alias("b")), ["series_id", "t"])
    return both.groupBy("series_id").agg(F.sqrt(F.avg(e)).alias("rmse"))
