"""Particle filters of many series in step: particles (S, n, d), one set of numpy calls a step for all series.

Each series draws from its own generator, so its result doesn't depend on what else is in the batch. The
steps are those of particles.py for additive models; a series without an observation moves and keeps equal weights.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..functions.linalg import Array, principal_sqrt
from ..functions.rand import quasi_normals
from ..models import GeneralModel, Model
from .batch import Sigma, turned
from .gaussian import Unscented
from .particles import each_logpdf, observation_covariances, slopes, step_covariances

METHODS = ("bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended", "sir_unscented")
GENERAL_METHODS = ("bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended_general")
#: Effective particles that are to be expected at each step, and the most particles that are taken for them.
LEAST, MOST = 50.0, 1 << 21
#: Share of the particles of Gaussian proposals that the transition itself moves, so that weights stay bounded where a proposal misses it.
DEFENSIVE = 0.5


def shares(model: Model | GeneralModel | Sequence[Model], ys: Array, of: str = "filter", lengths: Array | None = None) -> Array:
    """The share of effective particles (S) to be expected of a bootstrap filter, from the extended Kalman filter's predictions; `model` may be a model for each series.

    Weights N(y; Hx, R) of particles N(m, P) have the mean N(y; Hm, HPH' + R) and the mean square N(y; Hm, HPH' + R / 2) / sqrt(det(4 pi R)).
    It depends on the observations alone, not on what is drawn, so that likelihoods stay unbiased. of: filter, the least share of all steps; smoother, that of
    particles as predicted that the smoothed distribution leaves, where this is less; path, of the lines that lead from the first step to the last, of which each step loses some.
    """
    count, steps, dy = ys.shape
    general, several = isinstance(model, GeneralModel), not isinstance(model, (Model, GeneralModel))
    part = (lambda name: np.stack([np.asarray(getattr(v, name), float) for v in model])) if several else lambda name: np.repeat(np.asarray(getattr(model, name), float)[None], count, 0)
    m, p, q0, r0 = part("m0").reshape(count, -1), part("P0"), part("Q"), part("R")
    no_q, no_r = np.zeros((count, q0.shape[1])), np.zeros((count, r0.shape[1]))
    step = (lambda x: rows_of(model, "f", x[:, None])[:, 0]) if several else (lambda x: model.f(x, no_q)) if general else model.step
    observe = (lambda x: rows_of(model, "g", x[:, None])[:, 0]) if several else (lambda x: model.g(x, no_r)) if general else model.observe
    logs, moments, alive = np.zeros((count, steps)), [], np.ones(count, bool)

    def log_density(e: Array, c: Array) -> Array:
        if c.shape[-1] == 1:
            return -0.5 * (e[:, 0] * e[:, 0] / c[:, 0, 0] + np.log(2 * np.pi * c[:, 0, 0]))
        return -0.5 * (np.einsum("si,si->s", e, np.linalg.solve(c, e[..., None])[..., 0]) + np.linalg.slogdet(2 * np.pi * c)[1])

    with np.errstate(all="ignore"):
        for t in range(steps):
            q, f = q0, slopes(step, m)
            if general:
                l = slopes(lambda z, m=m: model.f(m, z), no_q)
                q = l @ q0 @ turned(l)
            m, p = step(m), f @ p @ turned(f) + q
            mp, pp = m, p
            seen = ~np.isnan(ys[:, t]).any(1)
            r = r0
            if general:
                v = slopes(lambda z, m=m: model.g(m, z), no_r)
                r = v @ r0 @ turned(v) + 1e-12 * np.eye(dy)
            h, e = slopes(observe, m), np.nan_to_num(ys[:, t]) - observe(m)
            around = h @ p @ turned(h)
            s = around + r
            fine = np.isfinite(s).all((1, 2)) & np.isfinite(e).all(1)
            alive &= fine
            seen &= alive
            if not fine.all():  # the linearisation has left the model: what was seen so far counts
                m, p, s, around, e = (np.where(fine.reshape(-1, *[1] * (k.ndim - 1)), k, 1.0 if k.ndim == 2 else np.eye(k.shape[1])) for k in (m, p, s, around, e))
            share = 2 * log_density(e, s) - log_density(e, around + r / 2) + 0.5 * np.linalg.slogdet(4 * np.pi * r)[1]
            logs[:, t] = np.where(seen, np.minimum(share, 0.0), 0.0)
            gain = turned(h @ p) / s if dy == 1 else turned(np.linalg.solve(s, h @ p))
            m = np.where(seen[:, None], m + np.einsum("sij,sj->si", gain, e), m)
            p = np.where(seen[:, None, None], p - gain @ s @ turned(gain), p)
            moments.append((mp, pp, m, p, f))
        least = np.nan_to_num(logs).min(1)
        if of == "path":
            live = np.arange(steps)[None] < (steps if lengths is None else np.asarray(lengths)[:, None])
            least = -np.log(np.where(live, np.exp(np.minimum(-logs, 700.0)), 0.0).sum(1))
        elif of == "smoother":
            ends = np.full(count, steps) if lengths is None else np.asarray(lengths)
            for t in range(steps - 1, -1, -1):
                mp, pp, m, p, _ = moments[t]
                if t == steps - 1:
                    ms, ps = m, p
                else:
                    ahead, cov, _, _, f = moments[t + 1]
                    g = turned(np.linalg.solve(cov, f @ p))
                    inner = (ends > t + 1)[:, None]
                    ms, ps = np.where(inner, m + np.einsum("sij,sj->si", g, ms - ahead), m), np.where(inner[..., None], p + g @ (ps - cov) @ turned(g), p)
                # the mean square of N(ms, ps) / N(mp, pp) over N(mp, pp), of precisions a and b
                a, b = np.linalg.inv(ps), np.linalg.inv(pp)
                c, e = 2 * a - b, ms - mp
                excess = 0.5 * np.einsum("si,sij,sj->s", e, b + b @ np.linalg.inv(c) @ b, e) + (np.linalg.slogdet(a)[1] - 0.5 * np.linalg.slogdet(b)[1] - 0.5 * np.linalg.slogdet(c)[1])
                least = np.where((t < ends) & (-excess < least), -excess, least)
    return np.exp(np.maximum(least, -700.0))


def rows_of(models: Sequence[Model], kind: str, x: Array) -> Array:
    """f or g of each series's model on its rows (S, n, d): one call where all are the same."""
    first = models[0]
    if all(getattr(m, kind) is getattr(first, kind) and m.theta == first.theta for m in models):
        return getattr(first, kind)(x.reshape(-1, x.shape[2]), first.theta).reshape(*x.shape[:2], -1)
    return np.stack([getattr(m, kind)(v, m.theta) for m, v in zip(models, x, strict=True)])


def counts(model: Model | GeneralModel | Sequence[Model], ys: Array, n: int, most: int = MOST, least: float = LEAST, of: str = "filter", lengths: Array | None = None) -> Array:
    """Particles of each series: n, or n times a power of 2 where the observations would leave fewer than `least` effective ones (see shares)."""
    need = np.maximum(least / (n * shares(model, ys, of, lengths)), 1.0)
    return n * 2 ** np.minimum(np.ceil(np.log2(need) - 1e-9), max(0, np.floor(np.log2(most / n)))).astype(int)


def searched(w: Array, u: Array) -> Array:
    """Indices of each series by inverse sums of its weights (S, n), of sorted numbers u in [0, 1); its sums are searched in an interval of their own."""
    count, n = w.shape
    sums = w.cumsum(1)
    sums /= sums[:, -1:]
    at = np.arange(count)[:, None]
    pick = np.searchsorted((np.minimum(sums, 1 - 1e-12) + at).ravel(), (u * (1 - 1e-12) + at).ravel(), "right").reshape(u.shape)
    return np.clip(pick - at * n, 0, n - 1)


class Cloud:
    def __init__(self, model: Model, ys: Array, n: int, rngs: Sequence[np.random.Generator]) -> None:
        self.model, self.ys, self.n, self.rngs = model, ys, n, list(rngs)
        self.count, self.d = len(ys), model.dim
        self.root_q = principal_sqrt(model.Q)
        self.x = model.m0 + self.normals() @ principal_sqrt(model.P0).T
        self.half = np.linalg.cholesky(model.R)
        self.log_norm = -np.log(np.diag(self.half)).sum() - 0.5 * len(model.R) * np.log(2 * np.pi)
        self.cov: Array | None = None

    def normals(self) -> Array:
        return np.stack([g.standard_normal((self.n, self.d)) for g in self.rngs])

    def ahead(self, x: Array) -> Array:
        return self.each(self.model.step, x)

    def moved(self, x: Array, quasi: bool = False) -> Array:
        return self.ahead(x) + self.noise(quasi)

    def noise(self, quasi: bool) -> Array:
        z = np.stack([quasi_normals(self.n, self.d, rng=g) for g in self.rngs]) if quasi else self.normals()
        return z @ self.root_q.T

    def each(self, f, x: Array) -> Array:
        """f, which maps rows to rows, on all particles."""
        return f(x.reshape(-1, x.shape[-1])).reshape(*x.shape[:2], -1)

    def log_weights(self, x: Array, y: Array, seen: Array) -> Array:
        e = np.nan_to_num(y)[:, None] - self.each(self.model.observe, x)
        z = e / self.half[0, 0] if len(self.half) == 1 else np.linalg.solve(self.half, e.reshape(-1, e.shape[2]).T).T.reshape(e.shape)
        return np.where(seen[:, None], self.log_norm - 0.5 * (z * z).sum(2), 0.0)

    def normalised(self, lw: Array) -> tuple[Array, Array]:
        """Weights, and the log of the mean of the given ones; equal weights where all vanish."""
        top = lw.max(1, keepdims=True)
        fine = np.isfinite(top)
        w = np.where(fine, np.exp(lw - np.where(fine, top, 0.0)), 1.0)
        total = w.sum(1, keepdims=True)
        return w / total, np.where(fine[:, 0], np.log(total[:, 0]) + np.where(fine, top, 0.0)[:, 0] - np.log(self.n), -np.inf)

    def stratified(self, w: Array) -> Array:
        """Sorted picks of each series, by one number in each of n strata: they spread less than independent ones, and are as unbiased."""
        return searched(w, (np.arange(self.n) + np.stack([g.random(self.n) for g in self.rngs])) / self.n)

    def taken(self, a: Array, pick: Array) -> Array:
        return a[np.arange(self.count)[:, None], pick]

    def proposed(self, mean: Array, cov: Array, ahead: Array, y: Array, seen: Array, moves: Array | None = None) -> tuple[Array, Array]:
        """Particles drawn from a mixture of Gaussian proposals (flat) and the transition (of covariances `moves`, or Q), and their log weights."""
        cov = (cov + turned(cov)) / 2
        z = self.normals().reshape(-1, self.d)
        root = np.sqrt(cov) if self.d == 1 else principal_sqrt(cov)
        if moves is None:
            moves = np.broadcast_to(self.model.Q, cov.shape)
            plain = z @ self.root_q.T
        else:
            plain = np.einsum("nij,nj->ni", np.sqrt(moves) if self.d == 1 else principal_sqrt(moves), z)
        defend = np.stack([g.random(self.n) for g in self.rngs]).reshape(-1, 1) < DEFENSIVE
        new = np.where(defend, ahead + plain, mean + np.einsum("nij,nj->ni", root, z))
        self.cov = cov.reshape(self.count, self.n, self.d, self.d)
        shaped = new.reshape(self.count, self.n, self.d)
        step = each_logpdf(new - ahead, moves)
        step = step - np.logaddexp(np.log(DEFENSIVE) + step, np.log(1 - DEFENSIVE) + each_logpdf(new - mean, cov))
        return shaped, self.log_weights(shaped, y, seen) + step.reshape(self.count, self.n)

    def moves(self) -> Array | None:
        """The transition's covariance at each particle, where it is not Q."""
        return None

    def kalman_proposals(self, y: Array, unscented: bool) -> tuple[Array, Array, Array]:
        """Mean and covariance of each particle's filtered proposal, and its prediction; flat."""
        model, d = self.model, self.d
        x = self.x.reshape(-1, d)
        p = np.broadcast_to(np.asarray(model.P0, float), (len(x), d, d)) if self.cov is None else self.cov.reshape(-1, d, d)
        obs = np.repeat(np.nan_to_num(y), self.n, 0)
        ahead = model.step(x)
        if unscented:
            sigma = Sigma(d, Unscented())
            m, _, c = sigma.through(model.step, sigma.points(x, p), model.Q)
            z = sigma.points(m, c)
            mu, dev, s = sigma.through(model.observe, z, model.R)
            cross = np.einsum("k,nki,nkj->nij", sigma.wc, z - m[:, None], dev)
        else:
            f = slopes(model.step, x)
            m, c = ahead, f @ p @ turned(f) + model.Q
            h, mu = slopes(model.observe, m), model.observe(m)
            cross = c @ turned(h)
            s = h @ cross + model.R
        gain = cross / s if s.shape[-1] == 1 else turned(np.linalg.solve(turned(s), turned(cross)))
        return m + np.einsum("nij,nj->ni", gain, obs - mu), c - gain @ s @ turned(gain), ahead

    def step(self, t: int, method: str) -> tuple[Array, Array, Array]:
        """Particles before resampling, weights and log likelihoods of step t; then resamples."""
        y = self.ys[:, t]
        seen = ~np.isnan(y).any(1)
        extra = 0.0
        if method == "auxiliary":
            first = self.log_weights(self.ahead(self.x), y, seen)
            w, extra = self.normalised(first)
            parents = self.stratified(w)
            x = self.moved(self.taken(self.x, parents))
            lw = self.log_weights(x, y, seen) - self.taken(first, parents)
        elif method.startswith("sir_"):
            mean, cov, ahead = self.kalman_proposals(y, method == "sir_unscented")
            moves = self.moves()
            if not seen.all():  # the transition itself proposes
                gone = np.repeat(~seen, self.n)
                mean[gone], cov[gone] = ahead[gone], self.model.Q if moves is None else moves[gone]
            x, lw = self.proposed(mean, cov, ahead, y, seen, moves)
        else:
            x = self.moved(self.x, method == "quasi_bootstrap")
            lw = self.log_weights(x, y, seen)
        w, ll = self.normalised(lw)
        pick = self.stratified(w)
        self.x = self.taken(x, pick)
        if self.cov is not None:
            self.cov = self.taken(self.cov, pick)
        return x, w, ll + extra


class GeneralCloud(Cloud):
    """The same for models whose noise is not additive: linearised at each particle."""

    def __init__(self, model: GeneralModel, ys: Array, n: int, rngs: Sequence[np.random.Generator]) -> None:
        self.model, self.ys, self.n, self.rngs = model, ys, n, list(rngs)
        self.count, self.d = len(ys), model.dim
        self.root_q = principal_sqrt(model.Q)
        self.x = model.m0 + self.normals() @ principal_sqrt(model.P0).T
        self.cov: Array | None = None

    def noise(self, quasi: bool) -> Array:
        dq = len(self.model.Q)
        z = np.stack([quasi_normals(self.n, dq, rng=g) if quasi else g.standard_normal((self.n, dq)) for g in self.rngs])
        return z @ self.root_q.T

    def ahead(self, x: Array) -> Array:
        flat = x.reshape(-1, self.d)
        return self.model.f(flat, np.zeros((len(flat), len(self.model.Q)))).reshape(x.shape)

    def moved(self, x: Array, quasi: bool = False) -> Array:
        q = self.noise(quasi)
        return self.model.f(x.reshape(-1, self.d), q.reshape(-1, q.shape[2])).reshape(x.shape)

    def log_weights(self, x: Array, y: Array, seen: Array) -> Array:
        flat = x.reshape(-1, self.d)
        e = np.repeat(np.nan_to_num(y), self.n, 0) - self.model.g(flat, np.zeros((len(flat), len(self.model.R))))
        return np.where(seen[:, None], each_logpdf(e, observation_covariances(self.model, flat, y.shape[1])).reshape(x.shape[:2]), 0.0)

    def moves(self) -> Array:
        return step_covariances(self.model, self.x.reshape(-1, self.d))

    def kalman_proposals(self, y: Array, unscented: bool) -> tuple[Array, Array, Array]:
        model, d = self.model, self.d
        x = self.x.reshape(-1, d)
        p = np.broadcast_to(np.asarray(model.P0, float), (len(x), d, d)) if self.cov is None else self.cov.reshape(-1, d, d)
        no_q, no_r = np.zeros((len(x), len(model.Q))), np.zeros((len(x), len(model.R)))
        ahead = model.f(x, no_q)
        f, l = slopes(lambda v: model.f(v, no_q), x), slopes(lambda z: model.f(x, z), no_q)
        c = f @ p @ turned(f) + l @ model.Q @ turned(l)
        h, v = slopes(lambda z: model.g(z, no_r), ahead), slopes(lambda z: model.g(ahead, z), no_r)
        cross = c @ turned(h)
        s = h @ cross + v @ model.R @ turned(v) + 1e-12 * np.eye(y.shape[1])
        gain = cross / s if s.shape[-1] == 1 else turned(np.linalg.solve(turned(s), turned(cross)))
        mean = ahead + np.einsum("nij,nj->ni", gain, np.repeat(np.nan_to_num(y), self.n, 0) - model.g(ahead, no_r))
        return mean, c - gain @ s @ turned(gain) + 1e-12 * np.eye(d), ahead


def cloud_of(model: Model | GeneralModel, ys: Array, n: int, rngs: Sequence[np.random.Generator]) -> Cloud:
    return (GeneralCloud if isinstance(model, GeneralModel) else Cloud)(model, ys, n, rngs)


def run(model: Model | GeneralModel, ys: Array, n: int, rngs: Sequence[np.random.Generator], method: str = "bootstrap") -> tuple[Array, Array, Array, Array]:
    """Means (S, T, d), covariances (S, T, d, d), log likelihoods and effective sample sizes (S, T) of observations (S, T, dy)."""
    if method not in (GENERAL_METHODS if isinstance(model, GeneralModel) else METHODS):
        raise ValueError(f"no method {method}")
    count, steps, _ = ys.shape
    cloud = cloud_of(model, ys, n, rngs)
    means, covs = np.empty((count, steps, model.dim)), np.empty((count, steps, model.dim, model.dim))
    ll, ess = np.empty((count, steps)), np.empty((count, steps))
    for t in range(steps):
        x, w, ll[:, t] = cloud.step(t, method)
        means[:, t] = np.einsum("sn,snd->sd", w, x)
        dev = x - means[:, t][:, None]
        covs[:, t] = np.einsum("sn,sni,snj->sij", w, dev, dev)
        ess[:, t] = 1 / (w * w).sum(1)
    return means, covs, ll, ess


def history(model: Model, ys: Array, n: int, rngs: Sequence[np.random.Generator], method: str = "bootstrap") -> tuple[Array, Array]:
    """Particles before resampling (S, T, n, d) and their weights (S, T, n)."""
    count, steps, _ = ys.shape
    cloud = Cloud(model, ys, n, rngs)
    x, w = np.empty((count, steps, n, model.dim)), np.empty((count, steps, n))
    for t in range(steps):
        x[:, t], w[:, t], _ = cloud.step(t, method)
    return x, w


#: Log weights that backward simulation holds at a time: few enough to stay in a cache.
DENSITIES = 1 << 17


def backward(model: Model, x: Array, w: Array, lengths: Array, draws: int, rngs: Sequence[np.random.Generator]) -> Array:
    """Backward-simulated trajectories (S, draws, T, d) from filtered particles; series s ends after lengths[s] steps."""
    count, steps, n, d = x.shape
    out = np.zeros((count, draws, steps, d))
    unwhite = np.linalg.inv(np.linalg.cholesky(model.Q))
    with np.errstate(divide="ignore"):
        log_w = np.maximum(np.log(w), -700.0)
    us = np.zeros((count, steps, draws))
    for s, k in enumerate(lengths):
        us[s, :k] = rngs[s].random((k, draws))
    ahead = model.step(x.reshape(-1, d)).reshape(x.shape) @ unwhite.T  # whitened, as are the next states below
    block = max(1, DENSITIES // (n * draws))
    for a in range(0, count, block):
        for t in range(int(lengths[a : a + block].max()) - 1, -1, -1):
            for some, first in ((a + np.flatnonzero(lengths[a : a + block] == t + 1), True), (a + np.flatnonzero(lengths[a : a + block] > t + 1), False)):
                if not len(some):
                    continue
                if first:
                    sums = np.repeat(np.exp(log_w[some, t] - log_w[some, t].max(1, keepdims=True)).cumsum(1)[:, None], draws, 1)
                else:
                    z = out[some, :, t + 1] @ unwhite.T
                    lw = np.zeros((len(some), draws, n))
                    for i in range(d):
                        e = z[:, :, None, i] - ahead[some, t][:, None, :, i]
                        e *= e
                        lw -= e
                    lw *= 0.5
                    lw += log_w[some, t][:, None]
                    lw -= lw.max(2, keepdims=True)
                    sums = np.cumsum(np.exp(lw, out=lw), 2, out=lw)
                u = us[some, t] * sums[:, :, -1]
                pick = (sums < u[..., None]).sum(2).clip(max=n - 1)
                out[some, :, t] = x[some[:, None], t, pick]
    return out


def rejection(model: Model, x: Array, w: Array, lengths: Array, draws: int, rngs: Sequence[np.random.Generator], rounds: int = 10) -> Array:
    """The same by rejection, of all series in step: `rounds` rounds a step, and exactly for what is then still pending."""
    count, steps, n, d = x.shape
    out = np.zeros((count, draws, steps, d))
    unwhite = np.linalg.inv(np.linalg.cholesky(model.Q))
    for t in range(int(lengths.max()) - 1, -1, -1):
        live = np.flatnonzero(lengths > t)
        u = np.zeros((count, rounds, 2, draws))
        for s in live:
            u[s] = rngs[s].random((rounds, 2, draws))
        last = lengths[live] == t + 1
        sums = w[live, t].cumsum(1)
        sums /= sums[:, -1:]
        starts = np.arange(len(live))  # sums of each series in an interval of their own
        sums = (np.minimum(sums, 1 - 1e-12) + starts[:, None]).ravel()
        now, ahead = x[live, t].reshape(-1, d), model.step(x[live, t].reshape(-1, d)) @ unwhite.T
        after = out[live, :, t + 1].reshape(-1, d) @ unwhite.T if t + 1 < steps else np.zeros((len(live) * draws, d))
        at = np.repeat(starts, draws)
        got = np.full(len(live) * draws, -1)
        pending = np.arange(len(got))
        for k in range(rounds):
            if not len(pending):
                break
            one, two = (u[live, k, i].ravel()[pending] for i in (0, 1))
            pick = np.searchsorted(sums, one * (1 - 1e-12) + at[pending], "right").clip(at[pending] * n, at[pending] * n + n - 1)
            e = after[pending] - ahead[pick]
            ok = last[at[pending]] | (two <= np.exp(-0.5 * (e * e).sum(1)))
            got[pending[ok]] = pick[ok]
            pending = pending[~ok]
        if len(pending):
            more = np.zeros((count, draws))
            for s in live[np.unique(at[pending])]:
                more[s] = rngs[s].random(draws)
            more = more[live].ravel()
            cells = ahead.reshape(len(live), n, d)
            with np.errstate(divide="ignore"):
                log_w = np.maximum(np.log(w[live, t]), -700.0)
            for a in range(0, len(pending), max(1, DENSITIES // n)):
                some = pending[a : a + max(1, DENSITIES // n)]
                e = after[some][:, None] - cells[at[some]]
                lw = log_w[at[some]] - 0.5 * (e * e).sum(2)
                c = np.exp(lw - lw.max(1, keepdims=True)).cumsum(1)
                got[some] = at[some] * n + (c < (more[some] * c[:, -1])[:, None]).sum(1).clip(max=n - 1)
        out[live, :, t] = now[got].reshape(len(live), draws, d)
    return out


def gibbs(model: Model, ys: Array, lengths: Array, start: Array, sweeps: int, n: int, rngs: Sequence[np.random.Generator], backward_draws: bool = False) -> Array:
    """Paths (S, sweeps, T, d) of particle Gibbs from the paths `start` (S, T, d), as estimation.particle_gibbs draws them one by one: with ancestor sampling, or with backward simulation."""
    count, steps, _ = ys.shape
    d, at = model.dim, np.arange(count)
    rows = at[:, None]
    root_q, root_p = principal_sqrt(model.Q), principal_sqrt(model.P0)
    unwhite_q, unwhite_r = (np.linalg.inv(np.linalg.cholesky(c)) for c in (model.Q, model.R))
    seen = ~np.isnan(ys).any(2)
    filled = np.where(seen[..., None], ys, 0.0) @ unwhite_r.T
    path, out = np.array(start, float), np.zeros((count, sweeps, steps, d))
    x, w, anc = np.empty((count, steps, n, d)), np.empty((count, steps, n)), np.zeros((count, steps, n), int)
    z, u, pick_u = np.zeros((count, steps, n, d)), np.zeros((count, steps, n)), np.zeros((count, steps))

    def drawn(weights: Array, v: Array) -> Array:
        """An index of each series' weights (S, n)."""
        sums = weights.cumsum(1)
        return (sums < (v * sums[:, -1])[:, None]).sum(1).clip(max=n - 1)

    for sweep in range(sweeps):
        first = np.empty((count, n, d))
        for s, k in enumerate(lengths):
            first[s] = rngs[s].standard_normal((n, d))
            z[s, :k] = rngs[s].standard_normal((k, n, d))
            u[s, :k] = rngs[s].random((k, n))
            pick_u[s, :k] = rngs[s].random(k)
        u.sort(2)
        before = model.m0 + first @ root_p.T
        for t in range(steps):
            if t:
                a = searched(w[:, t - 1], u[:, t])
                a[:, 0] = 0
                if not backward_draws:
                    e = (path[:, t][:, None] - ahead) @ unwhite_q.T
                    lw = np.log(np.maximum(w[:, t - 1], 1e-300)) - 0.5 * (e * e).sum(2)
                    a[:, 0] = drawn(np.exp(lw - lw.max(1, keepdims=True)), pick_u[:, t])
                anc[:, t] = a
                base = ahead[rows, a]
            else:
                base = model.step(before.reshape(-1, d)).reshape(count, n, d)
            now = base + z[:, t] @ root_q.T
            now[:, 0] = path[:, t]
            e = filled[:, t][:, None] - model.observe(now.reshape(-1, d)).reshape(count, n, -1) @ unwhite_r.T
            lw = np.where(seen[:, t][:, None], -0.5 * (e * e).sum(2), 0.0)
            lw = np.exp(lw - lw.max(1, keepdims=True))
            x[:, t], w[:, t] = now, lw / lw.sum(1, keepdims=True)
            ahead = model.step(now.reshape(-1, d)).reshape(count, n, d)
        if backward_draws:
            path = backward(model, x, w, lengths, 1, rngs)[:, 0]
        else:
            path = np.zeros_like(path)
            i = np.zeros(count, int)
            for t in range(steps - 1, -1, -1):
                ends = np.flatnonzero(lengths == t + 1)
                if len(ends):  # their last state is drawn with the number kept for the first step, which draws no ancestor
                    i[ends] = drawn(w[:, t], pick_u[:, 0])[ends]
                live = np.flatnonzero(lengths >= t + 1)
                path[live, t] = x[live, t, i[live]]
                i[live] = anc[live, t, i[live]]
        out[:, sweep] = path
    return out
