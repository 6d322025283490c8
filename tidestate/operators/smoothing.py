"""Smoothers on numpy arrays. Histories have time first: means (T, d), covariances (T, d, d), particles (T, n, d)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.density import mvn_logpdf, normalise
from ..functions.linalg import Array, jacobian, right_solve, symmetrise
from .gaussian import Unscented


def _at(a: Array, t: int) -> Array:
    """A constant matrix, or the one of step t."""
    return a if a.ndim == 2 else a[t]


def _backward(m: Array, p: Array, ahead: Callable[[int], tuple[Array, Array, Array]]) -> tuple[Array, Array, Array]:
    """ahead(t): predicted mean, predicted covariance, and cross covariance of step t with t + 1."""
    ms, ps, gains = m.copy(), p.copy(), np.zeros_like(p)
    for t in range(len(m) - 2, -1, -1):
        mp, pp, cross = ahead(t)
        g = right_solve(cross, pp)
        ms[t] = m[t] + g @ (ms[t + 1] - mp)
        ps[t] = symmetrise(p[t] + g @ (ps[t + 1] - pp) @ g.T)
        gains[t] = g
    return ms, ps, gains


def rts(m: Array, p: Array, a: Array, q: Array) -> tuple[Array, Array, Array]:
    """Rauch-Tung-Striebel. a and q may be constant or have one matrix a step (that of the step to t + 1 at t)."""

    def ahead(t: int) -> tuple[Array, Array, Array]:
        f = _at(a, t)
        return f @ m[t], f @ p[t] @ f.T + _at(q, t), p[t] @ f.T

    return _backward(m, p, ahead)


def extended_rts(m: Array, p: Array, psi: Callable, q: Array, jac: Callable | None = None) -> tuple[Array, Array, Array]:
    """psi maps one state."""

    def ahead(t: int) -> tuple[Array, Array, Array]:
        f = jac(m[t]) if jac else jacobian(psi, m[t])
        return np.atleast_1d(psi(m[t])), f @ p[t] @ f.T + _at(q, t), p[t] @ f.T

    return _backward(m, p, ahead)


def unscented_rts(m: Array, p: Array, psi: Callable, q: Array, ut: Unscented = Unscented()) -> tuple[Array, Array, Array]:
    """psi maps rows of states."""

    def ahead(t: int) -> tuple[Array, Array, Array]:
        x = ut.points(m[t], p[t])
        z = psi(x)
        mp, pp = ut.moments(z, _at(q, t))
        _, wc = ut.weights(m.shape[1])
        return mp, pp, (wc[:, None] * (x - m[t])).T @ (z - mp)

    return _backward(m, p, ahead)


def _drawn(log_w: Array, rng: np.random.Generator) -> Array:
    """An index from each row of log weights (draws, n), by inverse sums."""
    w = np.exp(log_w - log_w.max(1, keepdims=True)).cumsum(1)
    return (w < (rng.random(len(w)) * w[:, -1])[:, None]).sum(1).clip(max=w.shape[1] - 1)


def _ahead(out: Array, ahead: Array, log_w: Array, cov: Array) -> Array:
    """Log backward weights (draws, n): of the particles whose predictions are `ahead` given the drawn next states `out`."""
    unwhite = np.linalg.inv(np.linalg.cholesky(cov)).T
    out, ahead = out @ unwhite, ahead @ unwhite
    lw = np.zeros((len(out), len(ahead)))
    for i in range(out.shape[1]):
        e = out[:, None, i] - ahead[None, :, i]
        e *= e
        lw -= e
    lw *= 0.5
    lw += log_w
    return lw


def backward_simulation(x: Array, w: Array, draws: int, psi: Callable, q: Array, rng: np.random.Generator) -> Array:
    """Trajectories (draws, T, d) from filtering particles x (T, n, d) and weights w (T, n); all draws at once."""
    steps, n, d = x.shape
    out = np.empty((draws, steps, d))
    out[:, -1] = x[-1, rng.choice(n, draws, p=w[-1] / w[-1].sum())]
    for t in range(steps - 2, -1, -1):
        out[:, t] = x[t, _drawn(_ahead(out[:, t + 1], psi(x[t]), np.log(np.maximum(w[t], 1e-300)), _at(q, t)), rng)]
    return out


def rejection_backward_simulation(x: Array, w: Array, draws: int, psi: Callable, q: Array, rng: np.random.Generator, max_iter: int = 10) -> Array:
    """As backward_simulation, by rejection for max_iter rounds a step and exactly for what is then still pending."""
    steps, n, d = x.shape
    out = np.empty((draws, steps, d))
    out[:, -1] = x[-1, rng.choice(n, draws, p=w[-1] / w[-1].sum())]
    for t in range(steps - 2, -1, -1):
        ahead, cov = psi(x[t]), _at(q, t)
        p = w[t] / w[t].sum()
        bound = mvn_logpdf(np.zeros((1, d)), 0.0, cov)[0]
        pending = np.arange(draws)
        for _ in range(max_iter):
            if not len(pending):
                break
            pick = rng.choice(n, len(pending), p=p)
            ok = np.log(rng.random(len(pending))) + bound <= mvn_logpdf(out[pending, t + 1] - ahead[pick], 0.0, cov)
            out[pending[ok], t] = x[t, pick[ok]]
            pending = pending[~ok]
        if len(pending):
            out[pending, t] = x[t, _drawn(_ahead(out[pending, t + 1], ahead, np.log(np.maximum(p, 1e-300)), cov), rng)]
    return out


def path_smoother(model, ys: Array, n: int, rng: np.random.Generator) -> Array:
    """SIR over whole paths: at each step all histories are resampled. Paths (n, T, d)."""
    x = rng.multivariate_normal(model.m0, model.P0, n)
    half = np.linalg.cholesky(model.Q + 1e-300 * np.eye(model.dim))
    states, picks = [], []
    for y in ys:
        x = model.step(x) + rng.standard_normal(x.shape) @ half.T
        states.append(x)
        pick = np.arange(n)
        if not np.isnan(y).any():
            w, _ = normalise(mvn_logpdf(np.broadcast_to(y, (n, len(y))), model.observe(x), model.R))
            pick = np.sort(rng.choice(n, n, p=w))
            x = x[pick]
        picks.append(pick)
    paths, i = np.empty((n, len(states), model.dim)), np.arange(n)
    for t in range(len(states) - 1, -1, -1):  # histories are put together once, not at every step
        i = picks[t][i]
        paths[:, t] = states[t][i]
    return paths


def ancestral_path(x: Array, ancestors: Array, last: int | Array) -> Array:
    """The trajectory (T, d) that ends in particle `last`, or those (T, draws, d) that end in several; ancestors[t, i] is the particle of step t - 1 that i of t came from."""
    out = np.empty((x.shape[0], *np.shape(last), x.shape[2]))
    i = last
    for t in range(x.shape[0] - 1, -1, -1):
        out[t] = x[t, i]
        i = ancestors[t, i]
    return out
