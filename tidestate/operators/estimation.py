"""Parameter estimation on numpy arrays: likelihoods, Metropolis-Hastings and Gibbs chains, gradient ascent."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np

from ..functions.density import ess, mvn_logpdf, normalise
from ..functions.linalg import Array
from ..models import GeneralModel, Model
from . import particles as P
from .gaussian import run as gaussian_run
from .gaussian import scalar_loglik
from .smoothing import ancestral_path, backward_simulation


def kalman_loglik(model: Model, ys: Array) -> float:
    if model.dim == 1 and len(model.R) == 1:
        a, h = model.df(model.m0, model.theta), model.dg(model.m0, model.theta)
        return scalar_loglik(ys[:, 0], *(float(v.ravel()[0]) for v in (a, h, model.Q, model.R, model.m0, model.P0)))
    return float(gaussian_run(model, ys)[2].sum())


def linear_energy_step(m: Array, p: Array, y: Array, a: Array, h: Array, q: Array, r: Array) -> tuple[Array, Array, float]:
    """One Kalman step and its negative log likelihood, log det(2 pi S) / 2 included."""
    from .gaussian import predict, update

    m, p = predict(m, p, a, q)
    u = update(m, p, y, h, r)
    return u.mean, u.cov, -u.loglik


def sir_loglik(model: Model, ys: Array, n: int, rng: np.random.Generator, threshold: float = 0.5) -> float:
    """Log likelihood by sequential importance resampling with linear-Gaussian optimal proposals, resampling when the effective sample size falls below threshold * n."""
    a, h = model.df(model.m0, model.theta), model.dg(model.m0, model.theta)
    s = h @ model.Q @ h.T + model.R
    gain = model.Q @ h.T @ np.linalg.inv(s)
    root = np.linalg.cholesky(model.Q - gain @ s @ gain.T + 1e-12 * np.eye(model.dim))
    x, w, total = P.prior(model, n, rng), np.full(n, 1 / n), 0.0
    for y in ys:
        ahead = x @ a.T
        lw = np.log(w) + mvn_logpdf(np.broadcast_to(y, (n, len(y))), ahead @ h.T, s)
        w, ll = normalise(lw)
        total += ll + np.log(n)
        x = ahead + (y - ahead @ h.T) @ gain.T + rng.standard_normal(x.shape) @ root.T
        if ess(w) < threshold * n:
            x, w = x[P.systematic(w, rng)], np.full(n, 1 / n)
    return float(total)


def accept(log_ratio: float, rng: np.random.Generator) -> bool:
    return bool(np.log(rng.random()) < log_ratio)


def particle_mh(
    model: Model,
    ys: Array,
    steps: int,
    rng: np.random.Generator,
    start: Mapping,
    build: Callable[[Mapping], Model],
    propose: Callable[[Mapping, np.random.Generator], Mapping],
    log_prior: Callable[[Mapping], float],
    log_step: Callable[[Mapping, Mapping], float] = lambda now, then: 0.0,
    n: int = 100,
    method: str = "quasi_bootstrap",
) -> list[dict]:
    """Particle marginal Metropolis-Hastings: a row (theta, loglik, accepted) for the start and each of the steps.

    log_step(a, b) is log q(a | b), the density of proposing a from b.
    """
    theta, lp = dict(start), log_prior(start)
    ll = P.loglik(P.run(build(theta), ys, n, rng, method))
    out = [{"theta": theta, "loglik": ll, "accepted": True}]
    for _ in range(steps):
        new = dict(propose(theta, rng))
        new_lp = log_prior(new)
        ok = False
        if np.isfinite(new_lp):
            try:
                new_ll = P.loglik(P.run(build(new), ys, n, rng, method))
                ok = accept(new_lp - lp + new_ll - ll + log_step(theta, new) - log_step(new, theta), rng)
            except (np.linalg.LinAlgError, ValueError):  # a covariance that is none: rejected
                ok = False
        if ok:
            theta, lp, ll = new, new_lp, new_ll
        out.append({"theta": theta, "loglik": ll, "accepted": ok})
    return out


def noise_chain(model: Model, ys: Array, steps: int, rng: np.random.Generator, sd: float = 0.02, rate: float = 0.05, n: int = 100, method: str = "quasi_bootstrap") -> list[dict]:
    """particle_mh over the diagonal of Q: a random walk reflected at 0, with an exponential prior."""
    d = model.dim
    start = {f"q{i}": float(model.Q[i, i]) for i in range(d)}

    def build(t: Mapping) -> Model:
        q = np.array(model.Q, float)
        q[np.diag_indices(d)] = [t[f"q{i}"] for i in range(d)]
        return model.with_(Q=q)

    return particle_mh(model, ys, steps, rng, start, build, lambda t, g: {k: abs(v + sd * g.standard_normal()) for k, v in t.items()}, lambda t: -rate * sum(abs(v) for v in t.values()), n=n, method=method)


def parameter_chain(model: Model, ys: Array, steps: int, rng: np.random.Generator, name: str = "a", sd: float = 1.0, rate: float = 0.05, n: int = 100, method: str = "quasi_bootstrap") -> list[dict]:
    """particle_mh over one parameter of theta: a normal random walk, with a double exponential prior."""
    start = {name: float(model.theta[name])}
    return particle_mh(model, ys, steps, rng, start, lambda t: model.with_(theta={**model.theta, **t}), lambda t, g: {name: t[name] + sd * g.standard_normal()}, lambda t: -rate * abs(t[name]), n=n, method=method)


def root_chain(model: Model, ys: Array, steps: int, rng: np.random.Generator, scale: float = 0.05, n: int = 100) -> list[dict]:
    """particle_mh over m0, P0, Q and R: random walks on the mean and on symmetric square roots of the covariances, flat priors."""
    from ..functions.linalg import principal_sqrt, random_symmetric

    names = ("P0", "Q", "R")
    start = {"m0": model.m0, **{k: principal_sqrt(getattr(model, k)) for k in names}}

    def build(t: Mapping) -> Model:
        return model.with_(m0=t["m0"], **{k: t[k] @ t[k].T + 1e-9 * np.eye(len(t[k])) for k in names})

    def propose(t: Mapping, g: np.random.Generator) -> Mapping:
        return {"m0": t["m0"] + scale * g.standard_normal(len(t["m0"])), **{k: t[k] + scale * random_symmetric(len(t[k]), g) for k in names}}

    return particle_mh(model, ys, steps, rng, start, build, propose, lambda t: 0.0, n=n, method="bootstrap")


def conditional_smc(model: Model | GeneralModel, ys: Array, path: Array, n: int, rng: np.random.Generator, ancestor_sampling: bool = False) -> tuple[Array, Array, Array]:
    """A particle filter whose particle 0 follows the given path (T, d). Particles (T, n, d), weights (T, n), ancestors (T, n).

    With ancestor_sampling the path's past is drawn anew at each step (the kernel of particle Gibbs with ancestor sampling).
    """
    steps = len(ys)
    x, w, anc = np.empty((steps, n, model.dim)), np.empty((steps, n)), np.zeros((steps, n), int)
    for t, y in enumerate(ys):
        if t == 0:
            before = P.prior(model, n, rng)
        else:
            anc[t] = rng.choice(n, n, p=w[t - 1])
            anc[t, 0] = 0
            if ancestor_sampling:
                back, _ = normalise(np.log(np.maximum(w[t - 1], 1e-300)) + P.step_logpdf(model, x[t - 1], np.broadcast_to(path[t], (n, model.dim))))
                anc[t, 0] = rng.choice(n, p=back)
            before = x[t - 1, anc[t]]
        x[t] = P.moved(model, before, rng)
        x[t, 0] = path[t]
        w[t], _ = normalise(P.log_weights(model, x[t], y))
    return x, w, anc


def _draw(x: Array, w: Array, anc: Array, rng: np.random.Generator) -> Array:
    return ancestral_path(x, anc, int(rng.choice(w.shape[1], p=w[-1])))


def particle_gibbs(model: Model | GeneralModel, ys: Array, path: Array, steps: int, n: int, rng: np.random.Generator, backward: bool = False) -> Array:
    """Paths (steps, T, d) of particle Gibbs, with ancestor sampling, or with backward simulation if `backward`."""
    out = np.empty((steps, len(ys), model.dim))
    for s in range(steps):
        x, w, anc = conditional_smc(model, ys, path, n, rng, ancestor_sampling=not backward)
        path = backward_simulation(x, w, 1, model.step, model.Q, rng)[0] if backward else _draw(x, w, anc, rng)
        out[s] = path
    return out


def gibbs_parameters(model: Model, ys: Array, path: Array, steps: int, rng: np.random.Generator, name: str = "a", sd: float = 1.0, rate: float = 0.05, n: int = 100) -> list[dict]:
    """Particle Gibbs with backward sampling: paths given theta, then theta given the path by a Metropolis step."""
    theta, out = dict(model.theta), []

    def score(t: Mapping, p: Array) -> float:
        m = model.with_(theta=t)
        return float(P.first_logpdf(m, p[:1]).sum() + mvn_logpdf(p[1:], m.step(p[:-1]), m.Q).sum() + mvn_logpdf(ys, m.observe(p), m.R).sum() - rate * abs(t[name]))

    for _ in range(steps):
        path = particle_gibbs(model.with_(theta=theta), ys, path, 1, n, rng, backward=True)[0]
        new = {**theta, name: theta[name] + sd * rng.standard_normal()}
        ok = accept(score(new, path) - score(theta, path), rng)
        theta = new if ok else theta
        out.append({"theta": dict(theta), "loglik": score(theta, path), "accepted": ok})
    return out


def gradient(f: Callable[[Array], float], x: Array, step: float = 1e-5) -> Array:
    """Central differences of a scalar function."""
    e = np.eye(len(x)) * step * np.maximum(1, np.abs(x))[:, None]
    return np.array([(f(x + d) - f(x - d)) / (2 * d[i]) for i, d in enumerate(e)])


def gradient_ascent(f: Callable[[Array], float], x: Array, rate: float = 1e-3, rounds: int = 1000, tolerance: float = 1e-8) -> tuple[Array, list[float]]:
    """x after at most `rounds` steps up the gradient of f, and f at each."""
    x, seen = np.array(x, float), []
    for _ in range(rounds):
        seen.append(f(x))
        step = rate * gradient(f, x)
        x = x + step
        if np.abs(step).max() < tolerance:
            break
    return x, seen


