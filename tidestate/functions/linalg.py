"""Dense linear algebra that numpy lacks, for small state spaces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Array = np.ndarray


def symmetrise(a: Array) -> Array:
    """(a + a') / 2 of one matrix or a stack of them."""
    return (a + np.swapaxes(a, -1, -2)) / 2


def principal_sqrt(a: Array) -> Array:
    """The principal square root of symmetric positive semi-definite matrices (a stack is fine)."""
    w, v = np.linalg.eigh(symmetrise(np.asarray(a, float)))
    return (v * np.sqrt(np.clip(w, 0, None))[..., None, :]) @ np.swapaxes(v, -1, -2)


def right_solve(b: Array, a: Array) -> Array:
    """b @ inv(a)."""
    return np.swapaxes(np.linalg.solve(np.swapaxes(a, -1, -2), np.swapaxes(b, -1, -2)), -1, -2)


def expm(a: Array) -> Array:
    """Matrix exponential: scaling, a (6, 6) Padé approximant, squaring."""
    a = np.asarray(a, float)
    norm = np.abs(a).sum(1).max() if a.size else 0.0
    s = max(0, int(np.ceil(np.log2(norm))) + 2) if norm > 0 else 0
    x = a / 2.0**s
    c, power, num, den = 1.0, np.eye(len(a)), np.eye(len(a)), np.eye(len(a))
    for k in range(1, 7):
        c *= (7 - k) / (k * (13 - k))
        power = power @ x
        num += c * power
        den += (-1) ** k * c * power
    out = np.linalg.solve(den, num)
    for _ in range(s):
        out = out @ out
    return out


def lti_discretise(f: Array, dispersion: Array | None = None, q: Array | None = None, dt: float = 1.0) -> tuple[Array, Array]:
    """Transition A and noise covariance Q over dt of dx = F x dt + L dB with spectral density q, by matrix fractions."""
    f = np.asarray(f, float)
    n = len(f)
    dispersion = np.eye(n) if dispersion is None else np.asarray(dispersion, float)
    q = np.zeros((dispersion.shape[1],) * 2) if q is None else np.asarray(q, float)
    phi = np.block([[f, dispersion @ q @ dispersion.T], [np.zeros((n, n)), -f.T]])
    e = expm(phi * dt) @ np.vstack([np.zeros((n, n)), np.eye(n)])
    return expm(f * dt), right_solve(e[:n], e[n:])


def jacobian(f: Callable[[Array], Array], x: Array, step: float = 1e-6) -> Array:
    """Central differences of f at x, for models that give no Jacobian of their own."""
    x = np.asarray(x, float)
    cols = []
    for i in range(len(x)):
        h = step * max(1.0, abs(x[i]))
        e = np.zeros(len(x))
        e[i] = h
        cols.append((np.atleast_1d(f(x + e)) - np.atleast_1d(f(x - e))) / (2 * h))
    return np.stack(cols, -1)


def noise_covariance(add: Array, mul: Array, c: Array, compat: bool = False) -> Array:
    """Covariance of (add + mul) noise. compat weighs the pure terms twice, as the engine we match does (scalar noise only)."""
    add, mul = np.atleast_2d(add), np.atleast_2d(mul)
    turned = lambda a: np.swapaxes(a, -1, -2)  # noqa: E731  stacks of matrices are fine
    if compat:
        return mul @ c @ turned(add) + add @ c @ turned(mul) + 2 * (add @ c @ turned(add) + mul @ c @ turned(mul))
    v = add + mul
    return v @ c @ turned(v)


def random_symmetric(n: int, rng: np.random.Generator) -> Array:
    """Standard normal upper triangle, mirrored."""
    a = np.triu(rng.standard_normal((n, n)))
    return a + np.triu(a, 1).T


def entry_norm(a: Array) -> float:
    """Sum of absolute entries."""
    return float(np.abs(a).sum())


def asymmetry(stack: Array) -> float:
    """Sum over matrices of the entry norm of what symmetrising takes away."""
    return float(np.abs(stack - symmetrise(stack)).sum())
