"""Gaussian filters and smoothers of many series in step: arrays (S, T, ...), one numpy call a step for all series.

Series of unequal length are padded with NaN rows, which predict only; callers cut the padding off. The formulas are those
of gaussian.py and smoothing.py.
"""

from __future__ import annotations

import numpy as np

from ..functions.linalg import Array, principal_sqrt
from ..models import Model
from .gaussian import Unscented
from .particles import slopes


def turned(a: Array) -> Array:
    return np.swapaxes(a, -1, -2)


def derivative(model: Model, kind: str, x: Array) -> Array:
    """Jacobians (S, out, d) of f or g at each state: the model's own, or differences."""
    own = getattr(model, "d" + kind)
    if own is None:
        return slopes(model.step if kind == "f" else model.observe, x)
    first = np.asarray(own(x[0], model.theta), float)
    rows = [first, *(np.asarray(own(v, model.theta), float) for v in x[1:])]
    return np.stack(rows)


class Sigma:
    """Sigma points of a batch of states."""

    def __init__(self, d: int, ut: Unscented) -> None:
        self.wm, self.wc = ut.weights(d)
        self.width = np.sqrt(d + ut.spread(d))

    def points(self, m: Array, p: Array) -> Array:
        half = self.width * turned(np.sqrt(p) if p.shape[-1] == 1 else principal_sqrt(p))
        return np.concatenate([m[:, None], m[:, None] + half, m[:, None] - half], 1)

    def through(self, f, z: Array, noise: Array) -> tuple[Array, Array, Array]:
        """Mean, deviations and covariance of f (rows to rows) over the points."""
        out = f(z.reshape(-1, z.shape[2])).reshape(*z.shape[:2], -1)
        mean = np.einsum("k,ski->si", self.wm, out)
        dev = out - mean[:, None]
        return mean, dev, np.einsum("k,ski,skj->sij", self.wc, dev, dev) + noise


def run(model: Model, ys: Array, method: str = "kalman", joseph: bool = False, ut: Unscented = Unscented()) -> tuple[Array, Array, Array]:
    """Means (S, T, d), covariances (S, T, d, d) and log likelihoods (S, T) of observations (S, T, dy)."""
    if method not in ("kalman", "var3d", "extended", "unscented"):
        raise ValueError(f"no method {method}")
    count, steps, dy = ys.shape
    d = model.dim
    m, p = np.repeat(model.m0[None], count, 0).astype(float), np.repeat(np.asarray(model.P0, float)[None], count, 0)
    means, covs, ll = np.empty((count, steps, d)), np.empty((count, steps, d, d)), np.zeros((count, steps))
    sigma = Sigma(d, ut)
    eye = np.eye(d)
    fixed = method == "kalman"
    f0, h0 = (derivative(model, "f", m[:1]), derivative(model, "g", m[:1])) if fixed else (None, None)
    for t in range(steps):
        y = ys[:, t]
        seen = ~np.isnan(y).any(1)
        if method == "unscented":
            m, _, p = sigma.through(model.step, sigma.points(m, p), model.Q)
        elif method == "var3d":
            m = model.step(m)
        else:
            f = f0 if fixed else derivative(model, "f", m)
            m, p = (m @ f[0].T if fixed else model.step(m)), (f * f * p if d == 1 else f @ p @ turned(f)) + model.Q
        if seen.any():
            e_at = np.nan_to_num(y)
            if method == "unscented":
                z = sigma.points(m, p)
                mu, dev, s = sigma.through(model.observe, z, model.R)
                cross = np.einsum("k,ski,skj->sij", sigma.wc, z - m[:, None], dev)
            else:
                h = h0 if fixed else derivative(model, "g", m)
                mu = m @ h[0].T if fixed else model.observe(m)
                cross = p @ turned(h)
                s = (h * h * p if d == dy == 1 else h @ cross) + model.R  # in SQL's order: some models magnify the last bits
            if dy == 1:
                gain, logdet = cross / s, np.log(s[:, 0, 0])
                form = (e_at - mu)[:, 0] ** 2 / s[:, 0, 0]
            else:
                gain = turned(np.linalg.solve(turned(s), turned(cross)))
                logdet = np.linalg.slogdet(s)[1]
                form = np.einsum("si,si->s", e_at - mu, np.linalg.solve(s, (e_at - mu)[..., None])[..., 0])
            ll[:, t] = np.where(seen, -0.5 * (form + logdet + dy * np.log(2 * np.pi)), 0.0)
            m = np.where(seen[:, None], m + np.einsum("sij,sj->si", gain, e_at - mu), m)
            if method != "var3d":
                if joseph and fixed:
                    rest = eye - gain @ h0
                    new = rest @ p @ turned(rest) + gain @ model.R @ turned(gain)
                else:
                    new = p - (gain * gain * s if d == dy == 1 else gain @ s @ turned(gain))
                p = np.where(seen[:, None, None], (new + turned(new)) / 2, p)
        means[:, t], covs[:, t] = m, p
    return means, covs, ll


def smooth(model: Model, means: Array, covs: Array, lengths: Array, method: str = "kalman", ut: Unscented = Unscented()) -> tuple[Array, Array]:
    """Smoothed means and covariances of filtered ones; series s has lengths[s] steps, what lies beyond is left alone."""
    ms, ps = means.copy(), covs.copy()
    sigma = Sigma(model.dim, ut)
    f0 = derivative(model, "f", means[:1, 0]) if method == "kalman" else None
    for t in range(means.shape[1] - 2, -1, -1):
        live = np.flatnonzero(lengths > t + 1)
        m, p = means[live, t], covs[live, t]
        if method == "unscented":
            z = sigma.points(m, p)
            mp, dev, pp = sigma.through(model.step, z, model.Q)
            cross = np.einsum("k,ski,skj->sij", sigma.wc, z - m[:, None], dev)
        else:
            f = f0 if method == "kalman" else derivative(model, "f", m)
            mp, cross = (m @ f[0].T if method == "kalman" else model.step(m)), p @ turned(f)
            pp = f @ cross + model.Q
        g = cross / pp if model.dim == 1 else turned(np.linalg.solve(turned(pp), turned(cross)))
        ms[live, t] = m + np.einsum("sij,sj->si", g, ms[live, t + 1] - mp)
        new = p + g @ (ps[live, t + 1] - pp) @ turned(g)
        ps[live, t] = (new + turned(new)) / 2
    return ms, ps
