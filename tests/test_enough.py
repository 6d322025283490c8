"""Particles and picks that are enough for what is held against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestate import models
from tidestate.functions.rand import stream
from tidestate.operators import batch, batch_chains, batch_particles

WALK = models.random_walk(25.0, 2500.0, 50.0, 400.0)


def observed(k, steps=60):
    rng = np.random.default_rng(k)
    return np.round(rng.exponential(50.0, (1, steps, 1)), 2)


@pytest.mark.parametrize("name", ["path", "ancestral"])
def test_older_states_are_held_against_the_smoother(spark, sf, monkeypatch, name):
    """Paths that are wrong but for their last five steps don't agree."""
    from tidestate import checked, queries

    def wrong(obs, *_, **__):
        last = checked.smoothed(spark, sf).groupBy("series_id").agg(F.max("t").alias("n"))
        est = checked.smoothed(spark, sf).join(last, "series_id")
        return est.select("series_id", "t", F.when(F.col("t") > F.col("n") - 5, F.col("ms")).otherwise(F.col("ms") + 3 * F.sqrt("ps")).alias("e"), F.col("ps").alias("v"))

    monkeypatch.setattr(checked.series, "trajectory_moments", wrong)
    rows = queries.QUERIES[f"trajectories_{name}_agrees"](spark, sf).where("steps > 10").collect()
    assert rows and not any(r.mean_agrees for r in rows)


def test_lines_that_are_left_of_the_first_step():
    """Of so many particles about as many lines lead from the first step to the last as were asked for."""
    from tidestate.operators import particles

    ys = observed(1)
    n = int(batch_particles.counts(WALK, ys, 100, least=20.0, of="path")[0])
    left = []
    for seed in range(10):
        x, anc = particles.genealogy(particles.run(WALK, ys[0], n, np.random.default_rng(seed)))
        i = np.arange(n)
        for a in anc[:0:-1]:
            i = a[i]
        left.append(1 / ((np.bincount(i, minlength=n) / n) ** 2).sum())
    assert n > 1000 and np.mean(left) > 10


def test_smoothed_states_need_more_than_filtered_ones():
    ys = np.full((1, 40, 1), 50.0)
    ys[0, 25:] = 250.0
    of = [batch_particles.shares(WALK, ys, kind)[0] for kind in ("filter", "smoother", "path")]
    assert of[1] < 0.5 * of[0] and of[2] < of[0]
    assert batch_particles.counts(WALK, ys, 300, least=100.0, of="smoother")[0] > batch_particles.counts(WALK, ys, 300, least=100.0)[0]


def test_shares_do_not_depend_on_the_batch():
    ys = np.concatenate([observed(k) for k in range(3)])
    far = ys.copy()
    far[0, 5] = 1e200
    for kind in ("filter", "smoother", "path"):
        assert np.allclose(batch_particles.shares(WALK, far, kind)[1:], batch_particles.shares(WALK, ys, kind)[1:])


def test_rejection_in_step():
    """Means and variances of the exact smoother; a series's draws are the same alone."""
    ys = np.concatenate([observed(k) for k in range(2)])
    ys[1, 40:] = np.nan
    lengths = np.array([60, 40])
    m, p, _ = batch.run(WALK, ys)
    ms, ps = batch.smooth(WALK, m, p, lengths)
    x, w = batch_particles.history(WALK, ys, 3000, [stream("r", k) for k in range(2)])
    got = batch_particles.rejection(WALK, x, w, lengths, 200, [stream("d", k) for k in range(2)])
    alone = batch_particles.rejection(WALK, x[1:, :40], w[1:, :40], lengths[1:], 200, [stream("d", 1)])
    assert np.allclose(alone[0], got[1, :, :40])
    for k, n in enumerate(lengths):
        e = np.abs(got[k, :, :n, 0].mean(0) - ms[k, :n, 0]) / np.sqrt(ps[k, :n, 0, 0])
        assert e.mean() < 0.3 and 0.8 < (got[k, :, :n, 0].var(0) / ps[k, :n, 0, 0]).mean() < 1.25


def test_likelihoods_of_chains_spread_little():
    """Stratified picks: the standard deviation of the log likelihood was 0.48 here with independent ones."""
    ys = np.repeat(observed(3), 200, 0)
    got = batch_chains.logliks([WALK] * 200, ys, np.full(200, 60), 100, [stream("l", k) for k in range(200)], True)
    assert got.std() < 0.35


def test_chains_take_more_particles_where_few_would_be_left(monkeypatch):
    taken = []
    plain = batch_chains.logliks
    monkeypatch.setattr(batch_chains, "logliks", lambda models, ys, lengths, n, *rest: taken.append((len(ys), n)) or plain(models, ys, lengths, n, *rest))
    ys = np.repeat(np.full((1, 30, 1), 50.0), 2, 0)
    ys[1, 20] = 450.0
    batch_chains.noise_chain(WALK, ys, np.array([30, 30]), 1, [stream("t", k) for k in range(2)], sd=1.0, n=100, least=6.0)
    assert taken[0] == (1, 100) and taken[1][0] == 1 and taken[1][1] > 400


def test_sums_of_densities_by_series():
    from tidestate.operators.particles import gauss_sums

    rng = np.random.default_rng(0)
    centre, at = 3 * rng.standard_normal(2000) - 7, 4 * rng.standard_normal(500) - 7
    w = np.stack([np.full(2000, 1 / 2000), rng.random(2000) ** 20], 1)
    want = np.exp(-0.5 * (at[:, None] - centre[None]) ** 2) @ w
    assert np.allclose(gauss_sums(at, centre, w), want, rtol=1e-9, atol=1e-15)


def test_improved_auxiliary_takes_more_particles_for_observations_far_off(spark):
    """With 120 particles the filter stays behind where an observation is far off."""
    from tidestate.operators import gaussian
    from tidestate.plans import series

    ys = [50.0] * 10 + [500.0] + [50.0] * 3
    obs = spark.createDataFrame([(k, t, [y]) for k in range(4) for t, y in enumerate(ys, 1)], "series_id long, t int, ys array<double>")
    m, p, _ = gaussian.run(WALK, np.array(ys)[:, None])
    got = series.particle_filter(obs, WALK, "improved_auxiliary", 120, least=batch_particles.LEAST).toPandas().sort_values(["series_id", "t"])
    e = (np.stack(got["mean"])[:, 0].reshape(4, -1) - m[:, 0]) / np.sqrt(p[:, 0, 0])
    assert np.abs(e).mean() < 0.07  # 0.13 with 120 particles
