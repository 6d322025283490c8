"""Identities of the numpy operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestate import models
from tidestate.functions import density, linalg, rand
from tidestate.operators import estimation, gaussian, particles, smoothing

RNG = np.random.default_rng(3)


def simulated(model, steps, seed=0):
    rng = np.random.default_rng(seed)
    x, ys, xs = np.atleast_2d(model.m0), [], []
    for _ in range(steps):
        x = model.step(x) + particles.noise(model.Q, 1, rng)
        xs.append(x[0])
        ys.append((model.observe(x) + particles.noise(model.R, 1, rng))[0])
    return np.array(xs), np.array(ys)


def test_expm_and_lti():
    a = RNG.standard_normal((4, 4)) * 2
    series, term = np.eye(4), np.eye(4)
    for k in range(1, 80):
        term = term @ a / k
        series = series + term
    assert np.allclose(linalg.expm(a), series, rtol=1e-9)
    dt, qc = 0.3, 0.7
    f, q = linalg.lti_discretise([[0, 1], [0, 0]], [[0], [1]], [[qc]], dt)
    assert np.allclose(f, [[1, dt], [0, 1]]) and np.allclose(q, qc * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]))
    f, q = linalg.lti_discretise([[-1.0]])
    assert np.allclose(f, np.exp(-1)) and np.allclose(q, 0)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_principal_sqrt(n, seed):
    a = np.random.default_rng(seed).standard_normal((n, n))
    p = a @ a.T
    s = linalg.principal_sqrt(p)
    assert np.allclose(s, s.T) and np.allclose(s @ s, p, atol=1e-8)


def test_noise_covariance():
    c, a, m = np.array([[2.0]]), np.array([[0.5]]), np.array([[1.5]])
    assert np.allclose(linalg.noise_covariance(a, m, c), 8.0)
    assert np.allclose(linalg.noise_covariance(a, m, c, compat=True), 2 * 0.5 * 1.5 * 2 + 2 * 0.25 * 2 + 2 * 2.25 * 2)


def test_jacobian_and_symmetric():
    assert np.allclose(linalg.jacobian(lambda x: np.array([x[0] ** 2, x[0] * x[1]]), np.array([2.0, 3.0])), [[4, 0], [3, 2]], atol=1e-6)
    s = linalg.random_symmetric(4, RNG)
    assert np.allclose(s, s.T) and linalg.asymmetry(s) == 0 and linalg.entry_norm(-np.eye(3)) == 3


def test_densities():
    cov = np.array([[2.0, 0.3], [0.3, 1.0]])
    x = RNG.standard_normal((5, 2))
    direct = np.exp(-0.5 * np.einsum("ni,ij,nj->n", x, np.linalg.inv(cov), x)) / np.sqrt(np.linalg.det(2 * np.pi * cov))
    assert np.allclose(density.mvn_pdf(x, 0, cov), direct)
    assert np.allclose(density.mvn_logpdf_precision(x, 0, *density.precision_of(cov)), np.log(direct))
    assert density.log_mean_weight(np.array([1.0, 3.0])) == pytest.approx(np.log(2))
    assert density.log_mean_weight(np.array([[1.0, 2], [3, 2]])) == pytest.approx(np.log(4))
    w, ll = density.normalise(np.array([-1000.0, -1000.0]))
    assert np.allclose(w, 0.5) and ll == pytest.approx(-1000) and density.ess(w) == pytest.approx(2)
    assert density.normalise(np.array([-np.inf, -np.inf]))[0].sum() == pytest.approx(1)
    assert density.rmse(np.array([[0.0, 3], [0, 4]]), np.zeros((2, 2))) == pytest.approx(np.sqrt(12.5))
    assert density.rmse(np.array([1.0, 3]), np.zeros(2)) == pytest.approx(np.sqrt(5))


def test_marginal_likelihood():
    m = models.random_walk(0.5, 2.0)
    got = density.marginal_likelihood(np.array([1.0]), np.array([2.5]), m.step, m.observe, m.Q, m.R, [-9], [11], 80)
    assert got == pytest.approx(float(density.mvn_pdf([2.5], 1.0, [[2.5]])[0]), rel=1e-8)


def test_quasi_normals():
    z = rand.quasi_normals(4000, 3, np.array([1.0, 0, -1]), np.diag([1.0, 4, 9]), np.random.default_rng(0))
    assert np.allclose(z.mean(0), [1, 0, -1], atol=0.05) and np.allclose(np.cov(z.T), np.diag([1, 4, 9]), atol=0.3)
    assert rand.stream(1, "a").random() == rand.stream(1, "a").random() != rand.stream(1, "b").random()


@pytest.mark.parametrize("name", ["constant_velocity", "stable_linear"])
def test_linear_filters_agree(name):
    m = models.EXAMPLES[name]()
    _, ys = simulated(m, 40)
    ys[7] = np.nan
    ref = gaussian.run(m, ys)
    for method in ("extended", "unscented"):
        for a, b in zip(ref, gaussian.run(m, ys, method), strict=True):
            assert np.allclose(a, b, atol=1e-7)
    for a, b in zip(ref, gaussian.run(m, ys, joseph=True), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_joint_likelihood():
    m = models.stable_linear()
    _, ys = simulated(m, 6)
    a, h = m.df(m.m0, {}), m.dg(m.m0, {})
    mean, cov, means, covs = m.m0, m.P0, [], {}
    states = [np.linalg.matrix_power(a, k) for k in range(7)]
    for t in range(1, 7):
        means.append((h @ states[t] @ m.m0)[0])
    for s in range(1, 7):
        for t in range(1, 7):
            c = states[s] @ m.P0 @ states[t].T + sum(states[s - k] @ m.Q @ states[t - k].T for k in range(1, min(s, t) + 1))
            covs[s, t] = (h @ c @ h.T)[0, 0] + (m.R[0, 0] if s == t else 0)
    full = np.array([[covs[s, t] for t in range(1, 7)] for s in range(1, 7)])
    assert estimation.kalman_loglik(m, ys) == pytest.approx(float(density.mvn_logpdf(ys[:, 0], np.array(means), full)[0]))


def test_general_extended_steps():
    m, p, q, r = np.array([1.0, 2]), np.eye(2), np.diag([0.1, 0.2]), np.array([[0.5]])
    f = lambda x: np.array([x[0] + np.sin(x[1]), x[1]])
    a, b = gaussian.extended_predict(m, p, f, q), gaussian.extended_predict_general(m, p, lambda x, e: f(x) + e, q)
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(a, b, strict=True))
    h = lambda x: np.array([x[0] * x[1]])
    u, v = gaussian.extended_update(m, p, np.array([1.0]), h, r), gaussian.extended_update_general(m, p, np.array([1.0]), lambda x, e: h(x) + e, r)
    assert np.allclose(u.mean, v.mean, atol=1e-6) and np.allclose(u.cov, v.cov, atol=1e-6)
    hm = np.array([[1.0, 0]])
    assert np.allclose(gaussian.extended_update(m, p, np.array([1.0]), hm, r, compat=True).spread, gaussian.extended_update(m, p, np.array([1.0]), hm, r).spread + r)


def test_control_and_var3d():
    m, p = gaussian.predict(np.zeros(2), np.eye(2), u=np.array([3.0]))
    assert m.tolist() == [3, 0] and np.allclose(p, np.eye(2))
    m, p = gaussian.predict(np.zeros(2), np.eye(2), b=np.array([[0.0], [2.0]]), u=np.array([3.0]))
    assert m.tolist() == [0, 6]
    u = gaussian.var3d_update(np.zeros(2), np.eye(2), np.array([1.0]), np.array([[1.0, 0]]), np.eye(1))
    assert np.allclose(u.cov, np.eye(2)) and np.allclose(u.mean, [0.5, 0])


def test_unscented_weights_and_points():
    ut = gaussian.Unscented(0.7, 1.0, 2.0)
    p = np.array([[2.0, 0.5], [0.5, 1.0]])
    x, (wm, wc) = ut.points(np.array([1.0, -1]), p), ut.weights(2)
    assert wm.sum() == pytest.approx(1) and np.allclose(wm @ x, [1, -1])
    d = x - [1, -1]
    assert np.allclose((wc[1:, None] * d[1:]).T @ d[1:], p)
    assert np.allclose(ut.points(np.zeros(2), root=linalg.principal_sqrt(p)), ut.points(np.zeros(2), p))


def test_smoothers():
    m = models.constant_velocity()
    xs, ys = simulated(m, 60, 4)
    f, p, _ = gaussian.run(m, ys)
    a = m.df(None, {})
    ms, ps, g = smoothing.rts(f, p, a, m.Q)
    assert np.allclose(ms[-1], f[-1]) and all(np.linalg.eigvalsh(p[t] - ps[t]).min() > -1e-8 for t in range(60))
    assert density.rmse(xs[:, :1].T, ms[:, :1].T) < density.rmse(xs[:, :1].T, f[:, :1].T) < density.rmse(xs[:, :1].T, ys.T)
    for other in (smoothing.rts(f, p, np.repeat(a[None], 60, 0), np.repeat(m.Q[None], 60, 0)), smoothing.extended_rts(f, p, lambda x: a @ x, m.Q), smoothing.unscented_rts(f, p, m.step, m.Q)):
        assert np.allclose(other[0], ms, atol=1e-6) and np.allclose(other[1], ps, atol=1e-5)
    assert np.allclose(f, gaussian.run(m, ys)[0])  # inputs stay as they are


@pytest.mark.parametrize("method", ["bootstrap", "quasi_bootstrap", "auxiliary", "improved_auxiliary", "sir_extended", "sir_unscented"])
def test_particle_filters_follow_kalman(method):
    m = models.random_walk(1.0, 2.0)
    _, ys = simulated(m, 30, 2)
    ys[4] = np.nan
    ref, _, ll = gaussian.run(m, ys)
    n = 600 if method == "improved_auxiliary" else 3000
    steps = particles.run(m, ys, n, np.random.default_rng(1), method)
    assert np.abs(np.array([s.mean[0] for s in steps]) - ref[:, 0]).max() < 0.35
    assert particles.loglik(steps) == pytest.approx(ll.sum(), abs=3.0)
    assert all(1 <= s.ess <= n + 1e-6 and s.w.sum() == pytest.approx(1) for s in steps)


@pytest.mark.parametrize("method", ["bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended_general"])
def test_general_models(method):
    m = models.stochastic_volatility()
    ys = np.random.default_rng(0).standard_normal((20, 1))
    steps = particles.run(m, ys, 300, np.random.default_rng(1), method)
    assert np.isfinite(particles.loglik(steps)) and np.allclose(np.diff(particles.energy(steps)), [-s.loglik for s in steps[1:]])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=2, max_size=50), st.integers(0, 99))
def test_resampling_counts(w, seed):
    w = np.array(w) / np.sum(w)
    for f in (particles.systematic, particles.stratified):
        n = np.bincount(f(w, np.random.default_rng(seed)), minlength=len(w))
        assert n.sum() == len(w) and np.abs(n - len(w) * w).max() < (1 if f is particles.systematic else 2)


def test_trajectories():
    m = models.random_walk(1.0, 2.0)
    _, ys = simulated(m, 25, 5)
    f, p, _ = gaussian.run(m, ys)
    ms = smoothing.rts(f, p, np.eye(1), m.Q)[0][:, 0]
    steps = particles.run(m, ys, 800, np.random.default_rng(0))
    x, w = np.stack([s.x for s in steps]), np.stack([s.w for s in steps])
    for draw in (smoothing.backward_simulation, smoothing.rejection_backward_simulation):
        assert np.abs(draw(x, w, 200, m.step, m.Q, np.random.default_rng(1)).mean(0)[:, 0] - ms).max() < 0.6
    paths = smoothing.path_smoother(m, ys, 3000, np.random.default_rng(2))
    assert np.abs(paths.mean(0)[-5:, 0] - ms[-5:]).max() < 0.5
    x, anc = particles.genealogy(steps)
    path = smoothing.ancestral_path(x, anc, 3)
    assert path[-1] == x[-1, 3] and path[-2] == x[-2, anc[-1, 3]]


def test_chains_and_gibbs():
    m = models.cube_root()
    _, ys = simulated(m, 20, 6)
    rng = np.random.default_rng(0)
    for rows in (estimation.noise_chain(m, ys, 4, rng, n=30), estimation.parameter_chain(m, ys, 4, rng, n=30), estimation.root_chain(m, ys, 3, rng, n=30)):
        assert rows[0]["accepted"] and all(np.isfinite(r["loglik"]) for r in rows)
    x, w, anc = estimation.conditional_smc(m, ys, np.zeros((20, 2)), 25, rng)
    assert (x[:, 0] == 0).all() and (anc[:, 0] == 0).all() and np.allclose(w.sum(1), 1)
    assert estimation.particle_gibbs(m, ys, np.zeros((20, 2)), 3, 25, rng).shape == (3, 20, 2)
    assert len(estimation.gibbs_parameters(m, ys, np.zeros((20, 2)), 3, rng, n=20)) == 3
    steps, paths = particles.run_resample_move(m, ys, 30, rng)
    assert paths.shape == (30, 20, 2) and len(steps) == 20


def test_likelihood_estimates():
    m = models.stable_linear()
    _, ys = simulated(m, 40, 7)
    assert estimation.sir_loglik(m, ys, 2000, np.random.default_rng(0)) == pytest.approx(estimation.kalman_loglik(m, ys), abs=1.0)
    r = models.random_walk()
    assert estimation.kalman_loglik(r, ys) == pytest.approx(gaussian.run(r, ys)[2].sum())
    x, seen = estimation.gradient_ascent(lambda v: -((v - 3) ** 2).sum(), np.zeros(2), 0.2, 200)
    assert np.allclose(x, 3, atol=1e-4) and seen == sorted(seen)
    mean, cov, e = estimation.linear_energy_step(np.zeros(1), np.eye(1), np.ones(1), np.eye(1), np.eye(1), np.eye(1), np.eye(1))
    assert e == pytest.approx(-float(density.mvn_logpdf([1.0], 0.0, [[3.0]])[0]))


def test_validation():
    for name in models.EXAMPLES:
        models.validate(models.EXAMPLES[name]())
    with pytest.raises(ValueError, match="symmetric"):
        models.random_walk().with_(Q=np.array([[np.nan]]))
    with pytest.raises(ValueError, match="square"):
        models.stable_linear().with_(P0=np.eye(3))
    with pytest.raises(ValueError, match="observation"):
        models.random_walk().with_(R=np.eye(2))


def test_lorenz_converges():
    x = np.array([[1.0, 0, 0]])
    assert np.allclose(models.lorenz_step(x, 0.05, 10), models.lorenz_step(x, 0.05, 100), atol=1e-6)


@pytest.mark.parametrize("name, method", [("constant_velocity", "kalman"), ("pendulum", "extended"), ("pendulum", "unscented"), ("lorenz", "unscented"), ("constant_velocity", "var3d"), ("sine_growth", "extended")])
def test_batches_equal_single_series(name, method):
    from tidestate.operators import batch

    m = models.EXAMPLES[name]()
    ys = np.full((3, 20, len(m.R)), np.nan)
    for s, n in enumerate((20, 7, 1)):
        ys[s, :n] = simulated(m, n, s)[1]
    ys[0, 4] = np.nan
    means, covs, ll = batch.run(m, ys, method)
    for s, n in enumerate((20, 7, 1)):
        for a, b in zip(gaussian.run(m, ys[s, :n], method), (means[s, :n], covs[s, :n], ll[s, :n]), strict=True):
            assert np.allclose(a, b, atol=1e-6)
    if method != "var3d":
        ms, ps = batch.smooth(m, means, covs, np.array([20, 7, 1]), method)
        f, p = means[1, :7], covs[1, :7]
        one = smoothing.rts(f, p, m.df(None, {}), m.Q) if method == "kalman" else smoothing.extended_rts(f, p, lambda x: m.step(x)[0], m.Q, lambda x: m.df(x, {})) if method == "extended" else smoothing.unscented_rts(f, p, m.step, m.Q)
        assert np.allclose(one[0], ms[1, :7], atol=1e-6) and np.allclose(one[1], ps[1, :7], atol=1e-6)
        assert np.allclose(ms[2, 0], means[2, 0])


@pytest.mark.parametrize("method", ["bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended", "sir_unscented"])
def test_particle_batches_follow_kalman(method):
    from tidestate.operators import batch_particles

    m = models.random_walk(1.0, 2.0)
    ys = np.stack([simulated(m, 25, s)[1] for s in range(3)])
    ys[1, 4] = np.nan
    ys[2, 10:] = np.nan
    gens = lambda: [rand.stream("t", s) for s in range(3)]
    means, covs, ll, ess = batch_particles.run(m, ys, 3000, gens(), method)
    for s in range(3):
        ref, _, exact = gaussian.run(m, ys[s])
        live = 10 if s == 2 else 25
        assert np.abs(means[s, :live] - ref[:live]).max() < 0.4 and abs(ll[s].sum() - exact.sum()) < 3
    assert (ess >= 1).all() and (ess <= 3000 + 1e-6).all() and (covs[..., 0, 0] > 0).all()
    alone = batch_particles.run(m, ys[1:2], 3000, gens()[1:2], method)
    assert np.allclose(alone[0][0], means[1]) and np.allclose(alone[2][0], ll[1])


def test_particle_batches_in_three_dimensions():
    from tidestate.operators import batch_particles

    m = models.lorenz()
    xs, ys = simulated(m, 15, 3)
    for method in ("bootstrap", "sir_unscented", "sir_extended"):
        means, _, ll, _ = batch_particles.run(m, ys[None], 500, [rand.stream(1)], method)
        assert density.rmse(xs.T, means[0].T) < 4 and np.isfinite(ll).all()


def test_backward_batches_follow_the_smoother():
    from tidestate.operators import batch_particles

    m = models.random_walk(1.0, 2.0)
    ys = np.stack([simulated(m, 25, s)[1] for s in (5, 6)])
    ys[1, 15:] = np.nan
    gens = [rand.stream("b", s) for s in range(2)]
    x, w = batch_particles.history(m, ys, 1500, gens)
    paths = batch_particles.backward(m, x, w, np.array([25, 15]), 300, gens)
    for s, n in enumerate((25, 15)):
        f, p, _ = gaussian.run(m, ys[s, :n])
        ms = smoothing.rts(f, p, np.eye(1), m.Q)[0][:, 0]
        assert np.abs(paths[s, :, :n, 0].mean(0) - ms).max() < 0.5


@pytest.mark.parametrize("back", [False, True])
def test_gibbs_batches_follow_the_smoother(back):
    """Series in step, of unequal length and with a missing observation; a series draws the same alone."""
    from tidestate.operators import batch_particles

    m = models.random_walk(1.0, 2.0)
    ys = np.stack([simulated(m, 25, s)[1] for s in (5, 6)])
    ys[0, 4], ys[1, 15:] = np.nan, np.nan
    gens = lambda: [rand.stream("g", s) for s in range(2)]
    lengths = np.array([25, 15])
    paths = batch_particles.gibbs(m, ys, lengths, np.zeros((2, 25, 1)), 200, 100, gens(), back)
    for s, n in enumerate(lengths):
        f, p, _ = gaussian.run(m, ys[s, :n])
        ms = smoothing.rts(f, p, np.eye(1), m.Q)[0][:, 0]
        assert np.abs(paths[s, 20:, :n, 0].mean(0) - ms).max() < 0.5
    alone = batch_particles.gibbs(m, ys[1:, :15], lengths[1:], np.zeros((1, 15, 1)), 5, 100, gens()[1:], back)
    assert np.allclose(alone[0], paths[1, :5, :15])


def _in_step():
    m = models.random_walk(1.0, 2.0)
    ys = np.stack([simulated(m, 25, s)[1] for s in (5, 6)])
    ys[0, 4], ys[1, 15:] = np.nan, np.nan
    return m, ys, np.array([25, 15]), lambda which: [rand.stream("c", s) for s in which]


@pytest.mark.parametrize("kind", ["noises", "parameters", "roots"])
def test_chains_in_step(kind):
    """Each row's likelihood is near the exact one of its parameters; a series's chain is the same alone."""
    from tidestate.operators import batch_chains

    m, ys, lengths, gens = _in_step()
    if kind == "parameters":
        m = m.with_(f=lambda x, th: th["a"] * x, df=lambda x, th: np.array([[th["a"]]]), theta={"a": 1.0})
    chain = {"noises": lambda *a: batch_chains.noise_chain(*a, sd=0.5, n=1000), "parameters": lambda *a: batch_chains.parameter_chain(*a, sd=0.1, n=1000), "roots": lambda *a: batch_chains.root_chain(*a, scale=0.3, n=1000)}[kind]
    build = {
        "noises": lambda t: m.with_(Q=np.array([[t["q0"]]])),
        "parameters": lambda t: m.with_(theta=t),
        "roots": lambda t: m.with_(m0=t["m0"], **{k: t[k] @ t[k].T + 1e-9 * np.eye(1) for k in ("P0", "Q", "R")}),
    }[kind]
    both = chain(m, ys, lengths, 20, gens((0, 1)))
    alone = chain(m, ys[1:, :15], lengths[1:], 20, gens((1,)))[0]
    assert [r["loglik"] for r in alone] == pytest.approx([r["loglik"] for r in both[1]])
    for rows, y, n in zip(both, ys, lengths, strict=True):
        assert len(rows) == 21 and 1 < sum(r["accepted"] for r in rows) < 21
        for before, r in zip(rows, rows[1:], strict=False):
            assert r["accepted"] == (r["theta"] != before["theta"])
        seen = ~np.isnan(y[:n, 0])
        for r in rows:
            exact = gaussian.run(build(r["theta"]), y[:n])[2]
            assert abs(exact[seen].sum() - r["loglik"]) < 2


def test_chains_reject_what_is_no_covariance():
    from tidestate.operators import batch_chains

    m, ys, lengths, gens = _in_step()
    rows = batch_chains.particle_mh(m, ys, lengths, 3, gens((0, 1)), {"r": 2.0}, lambda t: m.with_(R=np.array([[t["r"]]])), lambda t, g: {"r": -1.0}, lambda t: 0.0, n=50)
    assert all([r["accepted"] for r in one] == [True, False, False, False] and one[-1]["theta"] == {"r": 2.0} for one in rows)


@pytest.mark.parametrize("name", ["lorenz", "cube_root_divisor", "stochastic_volatility"])
def test_simulated_in_step(name):
    """A series is the same whatever else is simulated; its states follow from each other."""
    from tidestate.sources import simulate

    ids, lengths = np.array([7, 3, 5]), np.array([30, 12, 1])
    both = simulate._in_step(models.EXAMPLES[name](), name, 0, ids, lengths)
    for i, k in zip(ids, lengths, strict=True):
        one, alone = both[both.series_id == i], simulate._in_step(models.EXAMPLES[name](), name, 0, np.array([i]), np.array([k]))
        assert one.t.tolist() == list(range(1, k + 1)) and np.allclose(np.stack(one.x.to_list()), np.stack(alone.x.to_list()))
        assert np.allclose(np.stack(one.ys.to_list()), np.stack(alone.ys.to_list()))


@pytest.mark.parametrize("n", [60, 100, 200])
def test_five_standard_errors_of_a_mean_square(n):
    """The exact chance of more (a Poisson sum) is that of five standard deviations; one in 3.5 million, not one in some ten thousand."""
    from math import exp, lgamma, log

    from tidestate.sources import simulate

    x = np.linspace(n, 4 * n, 100_000)
    far = x[int(np.argmax(simulate.deviation(x / n, np.full(len(x), n)) > 5))]
    chance = sum(exp(-far / 2 + i * log(far / 2) - lgamma(i + 1)) for i in range(n // 2))
    assert 2e-7 < chance < 4e-7


def test_counts_follow_what_weights_will_need():
    """An observation far off leaves few effective particles of a fixed number; so many are taken that some are left. Others keep theirs."""
    from tidestate.operators import batch_particles

    m = models.random_walk(25.0, 2500.0, 50.0, 400.0)
    ys = np.stack([50 + simulated(models.random_walk(0.1, 100.0), 40, s)[1] for s in range(2)])
    ys[1, 30] = 600.0
    for model in (m, models.general_random_walk(25.0, 2500.0, 50.0, 400.0)):
        n = batch_particles.counts(model, ys, 400)
        assert n[0] == 400 and n[1] > 6400
        means, _, _, ess = batch_particles.run(model, ys[1:], int(n[1]), [rand.stream("k", 1)])
        exact = gaussian.run(m, ys[1])[0]
        assert ess[0, 30] > 5 and np.abs(means[0] - exact).max() < 6


@pytest.mark.parametrize("method", ["sir_extended", "sir_unscented"])
def test_proposals_that_miss_the_transition(method):
    """Carried covariances propose too far towards an observation that is far off: the transition's own share bounds the weights."""
    from tidestate.operators import batch_particles

    m = models.random_walk(25.0, 2500.0, 50.0, 400.0)
    ys = 50 + simulated(models.random_walk(0.1, 100.0), 40, 1)[1]
    ys[30] = 400.0
    exact, p, ll = gaussian.run(m, ys)
    means, _, got, _ = batch_particles.run(m, np.repeat(ys[None], 20, 0), 1600, [rand.stream("d", s) for s in range(20)], method)
    assert np.abs(got.sum(1) - ll.sum()).max() < 3
    assert (np.abs(means - exact) / np.sqrt(p)[:, 0]).mean((1, 2)).max() < 0.4


def test_path_moments_stay_in_their_task(spark):
    from pyspark.sql import functions as F

    from tidestate.plans import series

    obs = spark.range(3).select(F.col("id").alias("series_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("t")).withColumn("ys", F.array((F.col("t") + F.col("series_id")).cast("double")))
    for method in ("backward", "rejection", "path", "ancestral"):
        paths = series.trajectories(obs, models.random_walk(), method, 10, 50)
        want = paths.groupBy("series_id", "t").agg(F.avg(F.col("x")[0]).alias("e"), F.var_samp(F.col("x")[0]).alias("v")).toPandas().sort_values(["series_id", "t"])
        got = series.trajectory_moments(obs, models.random_walk(), method, 10, 50).toPandas().sort_values(["series_id", "t"])
        assert len(got) == 24 and np.allclose(got[["e", "v"]], want[["e", "v"]])
