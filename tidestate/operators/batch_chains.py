"""Particle marginal Metropolis-Hastings of many series in step: each series has parameters, models and a generator of its own.

The chains are those of estimation.py; a series's chain doesn't depend on what else is in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np

from ..functions.linalg import Array, principal_sqrt, random_symmetric
from ..functions.rand import lattice
from ..models import Model
from .batch_particles import counts, rows_of, searched
from .estimation import accept


#: Particles of all series and steps that are held at a time.
HELD = 1 << 21


def _quasi(n: int, steps: int, d: int, rng: np.random.Generator) -> Array:
    """quasi_normals of every step (steps, n, d): a lattice shifted and shuffled anew for each."""
    pairs = (d + 1) // 2
    u = lattice(n, 2 * pairs, np.zeros(2 * pairs))[rng.permuted(np.tile(np.arange(n), (steps, 1)), axis=1)]
    u = np.clip((u + rng.random((steps, 1, 2 * pairs))) % 1.0, 1e-12, 1 - 1e-12)
    radius, angle = np.sqrt(-2 * np.log(u[..., :pairs])), 2 * np.pi * u[..., pairs:]
    if d == 1:
        return radius * np.cos(angle)
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], 2)[..., :d]


def logliks(models: Sequence[Model], ys: Array, lengths: Array, n: int, rngs: Sequence[np.random.Generator], quasi: bool) -> Array:
    """Log likelihood (S) of each series's observations (S, T, dy) under its own model, by the bootstrap filter."""
    count, steps, dy = ys.shape
    d = models[0].dim
    stacked = lambda name: np.stack([np.asarray(getattr(m, name), float) for m in models])
    root_q, root_p, half = principal_sqrt(stacked("Q")), principal_sqrt(stacked("P0")), np.linalg.cholesky(stacked("R"))
    unwhite = np.linalg.inv(half)
    norm = -np.log(np.diagonal(half, axis1=1, axis2=2)).sum(1) - 0.5 * dy * np.log(2 * np.pi)
    z, u, first = np.zeros((count, steps, n, d)), np.zeros((count, steps, n)), np.empty((count, n, d))
    for s, k in enumerate(lengths):
        first[s] = rngs[s].standard_normal((n, d))
        u[s, :k] = (np.arange(n) + rngs[s].random((k, n))) / n  # a pick in each of n strata: less spread than n independent ones, as unbiased
        z[s, :k] = _quasi(n, int(k), d, rngs[s]) if quasi else rngs[s].standard_normal((k, n, d))
    seen = ~np.isnan(ys).any(2)
    total = np.zeros(count)
    x = stacked("m0")[:, None] + first @ np.swapaxes(root_p, 1, 2)
    rows = np.arange(count)[:, None]
    for t in range(steps):
        x = rows_of(models, "f", x) + z[:, t] @ np.swapaxes(root_q, 1, 2)
        e = (np.nan_to_num(ys[:, t])[:, None] - rows_of(models, "g", x)) @ np.swapaxes(unwhite, 1, 2)
        lw = np.where(seen[:, t][:, None], norm[:, None] - 0.5 * (e * e).sum(2), 0.0)
        top = lw.max(1, keepdims=True)
        fine = np.isfinite(top)
        w = np.where(fine, np.exp(lw - np.where(fine, top, 0.0)), 1.0)
        with np.errstate(divide="ignore"):
            total += np.where(t < lengths, np.where(fine[:, 0], np.log(w.mean(1)) + np.where(fine, top, 0.0)[:, 0], -np.inf), 0.0)
        x = x[rows, searched(w, u[:, t])]
    return total


def each_loglik(models: Sequence[Model], ys: Array, lengths: Array, n: Array, rngs: Sequence[np.random.Generator], quasi: bool) -> Array:
    """logliks with n[s] particles for series s."""
    out = np.empty(len(ys))
    for k in np.unique(n):
        which = np.flatnonzero(n == k)
        size = max(1, HELD // (int(k) * ys.shape[1]))
        for a in range(0, len(which), size):
            some = which[a : a + size]
            longest = int(lengths[some].max())
            out[some] = logliks([models[s] for s in some], ys[some, :longest], lengths[some], int(k), [rngs[s] for s in some], quasi)
    return out


def particle_mh(
    model: Model,
    ys: Array,
    lengths: Array,
    steps: int,
    rngs: Sequence[np.random.Generator],
    start: Mapping,
    build: Callable[[Mapping], Model],
    propose: Callable[[Mapping, np.random.Generator], Mapping],
    log_prior: Callable[[Mapping], float],
    n: int = 100,
    method: str = "quasi_bootstrap",
    least: float = 0.0,
) -> list[list[dict]]:
    """estimation.particle_mh with symmetric proposals for each series: its rows (theta, loglik, accepted).

    n particles; with `least`, more for a series of which fewer than so many effective ones would be left of n under the first parameters (batch_particles.counts): no number
    depends on what is drawn, so chains stay exact.
    """
    if method not in ("bootstrap", "quasi_bootstrap"):
        raise ValueError(f"no method {method}")
    count = len(ys)
    quasi = method == "quasi_bootstrap"
    now, models = [dict(start) for _ in range(count)], [build(start)] * count
    lp = [log_prior(start)] * count
    each = counts(build(start), ys, n, least=least) if least else np.full(count, n)
    ll = each_loglik(models, ys, lengths, each, rngs, quasi)
    out = [[{"theta": t, "loglik": float(v), "accepted": True}] for t, v in zip(now, ll, strict=True)]
    for _ in range(steps):
        new = [dict(propose(t, g)) for t, g in zip(now, rngs, strict=True)]
        new_lp, built, valid = [log_prior(t) for t in new], list(models), np.zeros(count, bool)
        for s, t in enumerate(new):
            if np.isfinite(new_lp[s]):
                try:
                    candidate = build(t)
                    np.linalg.cholesky(candidate.R)
                    built[s], valid[s] = candidate, True
                except (np.linalg.LinAlgError, ValueError):  # a covariance that is none: rejected
                    pass
        some = np.flatnonzero(valid)
        new_ll = np.full(count, -np.inf)
        if len(some):
            new_ll[some] = each_loglik([built[s] for s in some], ys[some], lengths[some], each[some], [rngs[s] for s in some], quasi)
        for s in range(count):
            ok = bool(valid[s]) and accept(new_lp[s] - lp[s] + new_ll[s] - ll[s], rngs[s])
            if ok:
                now[s], models[s], lp[s], ll[s] = new[s], built[s], new_lp[s], new_ll[s]
            out[s].append({"theta": now[s], "loglik": float(ll[s]), "accepted": ok})
    return out


def noise_chain(model: Model, ys: Array, lengths: Array, steps: int, rngs: Sequence[np.random.Generator], sd: float = 0.02, rate: float = 0.05, n: int = 100, method: str = "quasi_bootstrap", least: float = 0.0) -> list[list[dict]]:
    """particle_mh over the diagonal of Q: a random walk reflected at 0, with an exponential prior."""
    d = model.dim
    start = {f"q{i}": float(model.Q[i, i]) for i in range(d)}

    def build(t: Mapping) -> Model:
        q = np.array(model.Q, float)
        q[np.diag_indices(d)] = [t[f"q{i}"] for i in range(d)]
        return model.with_(Q=q)

    return particle_mh(model, ys, lengths, steps, rngs, start, build, lambda t, g: {k: abs(v + sd * g.standard_normal()) for k, v in t.items()}, lambda t: -rate * sum(abs(v) for v in t.values()), n, method, least)


def parameter_chain(model: Model, ys: Array, lengths: Array, steps: int, rngs: Sequence[np.random.Generator], name: str = "a", sd: float = 1.0, rate: float = 0.05, n: int = 100, method: str = "quasi_bootstrap", least: float = 0.0) -> list[list[dict]]:
    """particle_mh over one parameter of theta: a normal random walk, with a double exponential prior."""
    start = {name: float(model.theta[name])}
    return particle_mh(model, ys, lengths, steps, rngs, start, lambda t: model.with_(theta={**model.theta, **t}), lambda t, g: {name: t[name] + sd * g.standard_normal()}, lambda t: -rate * abs(t[name]), n, method, least)


def root_chain(model: Model, ys: Array, lengths: Array, steps: int, rngs: Sequence[np.random.Generator], scale: float = 0.05, n: int = 100) -> list[list[dict]]:
    """particle_mh over m0, P0, Q and R: random walks on the mean and on symmetric square roots of the covariances, flat priors."""
    names = ("P0", "Q", "R")
    start = {"m0": model.m0, **{k: principal_sqrt(getattr(model, k)) for k in names}}

    def build(t: Mapping) -> Model:
        return model.with_(m0=t["m0"], **{k: t[k] @ t[k].T + 1e-9 * np.eye(len(t[k])) for k in names})

    def propose(t: Mapping, g: np.random.Generator) -> Mapping:
        return {"m0": t["m0"] + scale * g.standard_normal(len(t["m0"])), **{k: t[k] + scale * random_symmetric(len(t[k]), g) for k in names}}

    return particle_mh(model, ys, lengths, steps, rngs, start, build, propose, lambda t: 0.0, n, "bootstrap")
