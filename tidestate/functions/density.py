"""Gaussian densities and sums of weights, vectorised over particles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .linalg import Array


def mvn_logpdf(x: Array, mean: Array, cov: Array) -> Array:
    """Log density of each row of x - mean under N(0, cov)."""
    d = np.atleast_2d(np.asarray(x, float) - mean)
    cov = np.atleast_2d(cov)
    half = np.linalg.cholesky(cov)
    z = np.linalg.solve(half, d.T)
    return -0.5 * (z * z).sum(0) - np.log(np.diag(half)).sum() - 0.5 * d.shape[1] * np.log(2 * np.pi)


def mvn_logpdf_precision(x: Array, mean: Array, precision: Array, log_norm: float) -> Array:
    """As mvn_logpdf, from the inverse covariance and -log det / 2, made once for many calls."""
    d = np.atleast_2d(np.asarray(x, float) - mean)
    return log_norm - 0.5 * np.einsum("ni,ij,nj->n", d, precision, d) - 0.5 * d.shape[1] * np.log(2 * np.pi)


def precision_of(cov: Array) -> tuple[Array, float]:
    """Inverse and -log det / 2."""
    cov = np.atleast_2d(cov)
    return np.linalg.inv(cov), -0.5 * float(np.linalg.slogdet(cov)[1])


def mvn_pdf(x: Array, mean: Array, cov: Array) -> Array:
    return np.exp(mvn_logpdf(x, mean, cov))


def log_sum_exp(v: Array, axis: int | None = None) -> Array:
    top = np.max(v, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.exp(v - top).sum(axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def normalise(log_w: Array) -> tuple[Array, float]:
    """Weights that sum to 1, and the log of the mean of the given ones."""
    total = float(log_sum_exp(log_w))
    if not np.isfinite(total):
        return np.full(len(log_w), 1 / len(log_w)), -np.inf
    return np.exp(log_w - total), total - np.log(len(log_w))


def ess(w: Array) -> float:
    """Effective sample size of normalised weights."""
    return float(1 / np.square(w).sum())


def log_mean_weight(w: Array) -> Array:
    """log(sum / n) of a vector of weights; summed over the columns of a matrix (n, steps)."""
    w = np.asarray(w, float)
    return np.log(w.sum(0)) - np.log(len(w)) if w.ndim == 1 else (np.log(w.sum(0)) - np.log(len(w))).sum()


def weighted_moments(x: Array, w: Array) -> tuple[Array, Array]:
    """Mean and covariance of particles (n, d) under normalised weights."""
    m = w @ x
    d = x - m
    return m, (w[:, None] * d).T @ d


def rmse(truth: Array, estimate: Array) -> float:
    """Root of the mean over time (last axis) of squared error norms; vectors are series of scalars."""
    e = np.atleast_2d(np.asarray(truth, float) - np.asarray(estimate, float))
    return float(np.sqrt((e * e).sum(0).mean()))


def step_logdensity(before: Array, now: Array, obs: Array, f: Callable, g: Callable, q: Array, r: Array, compat: bool = False) -> Array:
    """log p(now | before) + log p(obs | now). compat takes the observation at the predicted state instead."""
    predicted = f(before)
    at = predicted if compat else now
    return mvn_logpdf(now, predicted, q) + mvn_logpdf(np.broadcast_to(obs, np.atleast_2d(g(at)).shape), g(at), r)


def marginal_likelihood(before: Array, obs: Array, f: Callable, g: Callable, q: Array, r: Array, low: Array, high: Array, points: int = 40) -> float:
    """p(obs | before): the one-step density integrated over a box by a tensor Gauss-Legendre rule."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    z, w = np.polynomial.legendre.leggauss(points)
    axes = [(a + b) / 2 + (b - a) / 2 * z for a, b in zip(low, high, strict=True)]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(low))
    weight = np.prod(np.stack(np.meshgrid(*[w * (b - a) / 2 for a, b in zip(low, high, strict=True)], indexing="ij"), -1).reshape(-1, len(low)), 1)
    before = np.broadcast_to(before, grid.shape)
    return float(weight @ np.exp(step_logdensity(before, grid, np.atleast_2d(obs), f, g, q, r)))
