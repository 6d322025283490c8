"""Gaussian filter steps on numpy arrays: Kalman, 3DVAR, extended and unscented, additive and not.

All take and return a mean (d,) and a covariance (d, d). Updates return an Update, whose loglik is the log of
the predictive density of the observation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.density import mvn_logpdf
from ..functions.linalg import Array, jacobian, principal_sqrt, right_solve, symmetrise


@dataclass
class Update:
    mean: Array
    cov: Array
    gain: Array
    predicted: Array  # the mean of the observation
    spread: Array  # its covariance
    loglik: float


def predict(m: Array, p: Array, a: Array | None = None, q: Array | None = None, b: Array | None = None, u: Array | None = None) -> tuple[Array, Array]:
    """Linear prediction with optional control; u without b enters the first states as it is."""
    n = len(m)
    a = np.eye(n) if a is None else a
    q = np.zeros((n, n)) if q is None else q
    m = a @ m
    if u is not None:
        m = m + (np.eye(n, len(u)) if b is None else b) @ u
    return m, a @ p @ a.T + q


def _updated(m: Array, p: Array, y: Array, mu: Array, h: Array, s: Array) -> Update:
    gain = right_solve(p @ h.T, s)
    return Update(m + gain @ (y - mu), symmetrise(p - gain @ s @ gain.T), gain, mu, s, float(mvn_logpdf(y, mu, s)[0]))


def update(m: Array, p: Array, y: Array, h: Array, r: Array) -> Update:
    return _updated(m, p, y, h @ m, h, h @ p @ h.T + r)


def update_joseph(m: Array, p: Array, y: Array, h: Array, r: Array) -> Update:
    """The update that keeps the covariance positive semi-definite under rounding."""
    u = update(m, p, y, h, r)
    rest = np.eye(len(m)) - u.gain @ h
    u.cov = symmetrise(rest @ p @ rest.T + u.gain @ r @ u.gain.T)
    return u


def var3d_predict(m: Array, p: Array, psi: Callable | None = None, b: Array | None = None, u: Array | None = None) -> tuple[Array, Array]:
    """3DVAR keeps its covariance."""
    m = m if psi is None else psi(m)
    if u is not None:
        m = m + (np.eye(len(m), len(u)) if b is None else b) @ u
    return m, p


def var3d_update(m: Array, p: Array, y: Array, h: Array, r: Array) -> Update:
    u = update(m, p, y, h, r)
    u.cov = p
    return u


def extended_predict(m: Array, p: Array, psi: Callable, q: Array, jac: Callable | None = None) -> tuple[Array, Array]:
    f = jac(m) if jac else jacobian(psi, m)
    return np.atleast_1d(psi(m)), f @ p @ f.T + q


def extended_predict_general(m: Array, p: Array, f: Callable[[Array, Array], Array], q: Array) -> tuple[Array, Array]:
    """f(x, noise), linearised in both at no noise."""
    zero = np.zeros(len(q))
    fx, fq = jacobian(lambda x: f(x, zero), m), jacobian(lambda e: f(m, e), zero)
    return np.atleast_1d(f(m, zero)), fx @ p @ fx.T + fq @ q @ fq.T


def extended_update(m: Array, p: Array, y: Array, h: Callable | Array, r: Array, jac: Callable | None = None, compat: bool = False) -> Update:
    """h: a function, or a matrix (compat then adds r twice, as the engine we match does)."""
    if callable(h):
        hx = np.atleast_2d(jac(m) if jac else jacobian(h, m))
        return _updated(m, p, y, np.atleast_1d(h(m)), hx, hx @ p @ hx.T + r)
    return _updated(m, p, y, h @ m, h, h @ p @ h.T + (2 * r if compat else r))


def extended_update_general(m: Array, p: Array, y: Array, h: Callable[[Array, Array], Array], r: Array) -> Update:
    zero = np.zeros(len(r))
    hx, hr = jacobian(lambda x: h(x, zero), m), jacobian(lambda e: h(m, e), zero)
    return _updated(m, p, y, np.atleast_1d(h(m, zero)), hx, hx @ p @ hx.T + hr @ r @ hr.T)


@dataclass(frozen=True)
class Unscented:
    alpha: float = 1.0
    kappa: float | None = None  # 3 - d if not given
    beta: float = 0.0

    def spread(self, n: int) -> float:
        kappa = 3.0 - n if self.kappa is None else self.kappa
        return self.alpha**2 * (n + kappa) - n

    def weights(self, n: int) -> tuple[Array, Array]:
        """For means and for covariances, the centre first."""
        lam = self.spread(n)
        wm = np.full(2 * n + 1, 1 / (2 * (n + lam)))
        wc = wm.copy()
        wm[0] = lam / (n + lam)
        wc[0] = wm[0] + 1 - self.alpha**2 + self.beta
        return wm, wc

    def points(self, m: Array, p: Array | None = None, root: Array | None = None) -> Array:
        """Sigma points (2d + 1, d), from the covariance or its square root."""
        n = len(m)
        root = principal_sqrt(p) if root is None else root
        d = np.sqrt(n + self.spread(n)) * root.T
        return np.concatenate([m[None], m + d, m - d])

    def moments(self, points: Array, noise: Array) -> tuple[Array, Array]:
        wm, wc = self.weights(points.shape[0] // 2)
        m = wm @ points
        d = points - m
        return m, (wc[:, None] * d).T @ d + noise

    def predict(self, m: Array, p: Array | None, psi: Callable, q: Array, root: Array | None = None) -> tuple[Array, Array]:
        """psi maps rows of states."""
        return self.moments(psi(self.points(m, p, root)), q)

    def update(self, m: Array, p: Array, y: Array, h: Callable, r: Array, root: Array | None = None) -> Update:
        """Draws its points anew from the predicted mean and covariance. h maps rows of states."""
        x = self.points(m, p, root)
        z = h(x)
        _, wc = self.weights(len(m))
        mu, s = self.moments(z, r)
        cross = (wc[:, None] * (x - m)).T @ (z - mu)
        gain = right_solve(cross, s)
        return Update(m + gain @ (y - mu), symmetrise(p - gain @ s @ gain.T), gain, mu, s, float(mvn_logpdf(y, mu, s)[0]))


def run(model, ys: Array, method: str = "kalman", unscented: Unscented = Unscented(), joseph: bool = False) -> tuple[Array, Array, Array]:
    """Filters one series of observations (T, dy) with a models.Model: means (T, d), covariances (T, d, d), log likelihoods (T,).

    A row of NaN is a step without observation: it is predicted only, with log likelihood 0. methods: kalman,
    var3d, extended, unscented.
    """
    d = model.dim
    m, p = model.m0.copy(), np.asarray(model.P0, float).copy()
    means, covs, ll = np.empty((len(ys), d)), np.empty((len(ys), d, d)), np.zeros(len(ys))
    one = lambda f: lambda x: f(x[None])[0]
    f1, g1 = one(model.step), one(model.observe)
    df = (lambda x: model.df(x, model.theta)) if model.df else None
    dg = (lambda x: model.dg(x, model.theta)) if model.dg else None
    for t, y in enumerate(ys):
        if method == "kalman":
            m, p = predict(m, p, model.df(m, model.theta), model.Q)
        elif method == "var3d":
            m, p = var3d_predict(m, p, f1)
        elif method == "extended":
            m, p = extended_predict(m, p, f1, model.Q, df)
        elif method == "unscented":
            m, p = unscented.predict(m, p, model.step, model.Q)
        else:
            raise ValueError(f"no method {method}")
        if not np.isnan(y).any():
            if method == "kalman":
                u = (update_joseph if joseph else update)(m, p, y, model.dg(m, model.theta), model.R)
            elif method == "var3d":
                u = var3d_update(m, p, y, dg(m) if dg else jacobian(g1, m), model.R)
            elif method == "extended":
                u = extended_update(m, p, y, g1, model.R, dg)
            else:
                u = unscented.update(m, p, y, model.observe, model.R)
            m, p, ll[t] = u.mean, u.cov, u.loglik
        means[t], covs[t] = m, p
    return means, covs, ll


def scalar_loglik(ys: Array, a: float, h: float, q: float, r: float, m: float, p: float) -> float:
    """Log likelihood of a linear model of one state and one observed value; NaN is a step without observation."""
    total, steps = 0.0, 0
    for y in ys.tolist():
        m, p = a * m, a * a * p + q
        if y == y:
            s = h * h * p + r
            e = y - h * m
            k = p * h / s
            total += math.log(s) + e * e / s
            steps += 1
            m, p = m + k * e, p - k * k * s
    return -0.5 * (total + steps * math.log(2 * math.pi))
