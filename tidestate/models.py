"""State-space models: their parts, checks, and the standing examples.

f and g are vectorised over rows of states (n, d) and take the parameters; additive-noise models are
x' = f(x) + N(0, Q), y = g(x) + N(0, R). General models have f(x, q) = add_f(x, q) + mul_f(x, q) and the like for g.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np

Array = np.ndarray


@dataclass(frozen=True)
class Model:
    f: Callable[[Array, Mapping], Array]
    g: Callable[[Array, Mapping], Array]
    Q: Array
    R: Array
    m0: Array
    P0: Array
    theta: Mapping = field(default_factory=dict)
    df: Callable[[Array, Mapping], Array] | None = None
    dg: Callable[[Array, Mapping], Array] | None = None

    @property
    def dim(self) -> int:
        return len(self.m0)

    def step(self, x: Array) -> Array:
        return self.f(np.atleast_2d(x), self.theta)

    def observe(self, x: Array) -> Array:
        return self.g(np.atleast_2d(x), self.theta)

    def with_(self, **parts: object) -> Model:
        return validate(replace(self, **parts))


@dataclass(frozen=True)
class GeneralModel:
    """Noise enters through add_f(x, q) and mul_f(x, q) (their sum is the transition), and add_g(x, r), mul_g(x, r)."""

    add_f: Callable[[Array, Array, Mapping], Array]
    mul_f: Callable[[Array, Array, Mapping], Array]
    add_g: Callable[[Array, Array, Mapping], Array]
    mul_g: Callable[[Array, Array, Mapping], Array]
    Q: Array
    R: Array
    m0: Array
    P0: Array
    theta: Mapping = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return len(self.m0)

    def f(self, x: Array, q: Array) -> Array:
        return self.add_f(x, q, self.theta) + self.mul_f(x, q, self.theta)

    def g(self, x: Array, r: Array) -> Array:
        return self.add_g(x, r, self.theta) + self.mul_g(x, r, self.theta)


def _square(name: str, a: Array, n: int | None = None) -> None:
    if a.ndim != 2 or a.shape[0] != a.shape[1] or (n is not None and len(a) != n):
        raise ValueError(f"{name} has to be a square matrix" + (f" of {n} rows" if n is not None else ""))
    if not np.allclose(a, a.T):
        raise ValueError(f"{name} has to be symmetric")


def validate(model: Model | GeneralModel) -> Model | GeneralModel:
    """The model, if its shapes fit each other; ValueError if not."""
    d = model.dim
    _square("P0", np.asarray(model.P0), d)
    _square("Q", np.asarray(model.Q), d if isinstance(model, Model) else None)
    _square("R", np.asarray(model.R))
    x = np.atleast_2d(model.m0)
    if isinstance(model, Model):
        state, obs = model.step(x), model.observe(x)
    else:
        state, obs = model.f(x, np.zeros((1, len(model.Q)))), model.g(x, np.zeros((1, len(model.R))))
    if state.shape != (1, d):
        raise ValueError("f has to return a state for each state")
    if isinstance(model, Model) and obs.shape != (1, len(model.R)):
        raise ValueError("g has to return an observation of R's size for each state")
    return model


def linear(a: Array, h: Array, q: Array, r: Array, m0: Array, p0: Array) -> Model:
    a, h = np.atleast_2d(a).astype(float), np.atleast_2d(h).astype(float)
    return validate(Model(lambda x, _: x @ a.T, lambda x, _: x @ h.T, np.atleast_2d(q).astype(float), np.atleast_2d(r).astype(float), np.asarray(m0, float), np.atleast_2d(p0).astype(float), {}, lambda x, _: a, lambda x, _: h))


def constant_velocity() -> Model:
    return linear([[1, 1], [0, 1]], [[1, 0]], np.diag([0.01, 1]), [[100]], [0, 0], np.eye(2))


def stable_linear() -> Model:
    return linear([[1, 1], [0, 0.5]], [[1, 0]], 0.1 * np.eye(2), [[1]], [0.1, 0], 0.1 * np.eye(2))


def random_walk(q: float = 0.1, r: float = 4.0, m0: float = 0.0, p0: float = 1.0) -> Model:
    return linear([[1]], [[1]], [[q]], [[r]], [m0], [[p0]])


def cube_root(a: float = 10.0, divisor: bool = False) -> Model:
    def f(x: Array, th: Mapping) -> Array:
        pull = -np.cbrt(x[:, 0] - th["a"])
        return np.stack([x[:, 0] + x[:, 1], pull / (x[:, 0] + 2) if divisor else pull], 1)

    return validate(Model(f, lambda x, _: x[:, :1], np.diag([0.01, 1.0]), np.array([[4.0]]), np.zeros(2), np.eye(2), {"a": a}))


def pendulum(dt: float = 0.01, qc: float = 0.001, r: float = 0.3) -> Model:
    q = qc * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
    return validate(Model(lambda x, _: np.stack([x[:, 0] + x[:, 1] * dt, x[:, 1] - 9.81 * np.sin(x[:, 0]) * dt], 1), lambda x, _: np.sin(x[:, :1]), q, np.array([[r]]), np.array([0.5, 0.0]), np.eye(2), {}, lambda x, _: np.array([[1, dt], [-9.81 * np.cos(x[0]) * dt, 1]]), lambda x, _: np.array([[np.cos(x[0]), 0.0]])))


def sine_growth() -> Model:
    """One dimension, f = x + sin x, g = x**2 / 20."""
    return validate(Model(lambda x, _: x + np.sin(x), lambda x, _: x * x / 20, np.eye(1), 25 * np.eye(1), np.ones(1), np.eye(1), {}, lambda x, _: np.array([[1 + np.cos(x[0])]]), lambda x, _: np.array([[x[0] / 10]])))


def stochastic_volatility(phi: float = 0.91, scale: float = 0.5) -> GeneralModel:
    zero = lambda x, n, th: np.zeros_like(x)
    return validate(GeneralModel(lambda x, q, th: th["phi"] * x + q, zero, zero, lambda x, r, th: th["scale"] * np.exp(x / 2) * r, np.eye(1), np.eye(1), np.zeros(1), 2 * np.eye(1), {"phi": phi, "scale": scale}))


def general_random_walk(q: float = 0.1, r: float = 4.0, m0: float = 0.0, p0: float = 1.0) -> GeneralModel:
    """random_walk in the form of a general model, so that methods for general noise can be held against the Kalman filter."""
    zero = lambda x, n, th: np.zeros_like(x)
    return validate(GeneralModel(lambda x, n, th: x + n, zero, lambda x, n, th: x + n, zero, np.array([[q]]), np.array([[r]]), np.array([m0]), np.array([[p0]])))


def lorenz_step(x: Array, dt: float = 0.05, parts: int = 10, sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3) -> Array:
    """Classical Runge-Kutta over dt in equal parts, rows of states (n, 3)."""

    def slope(s: Array) -> Array:
        return np.stack([sigma * (s[:, 1] - s[:, 0]), s[:, 0] * (rho - s[:, 2]) - s[:, 1], s[:, 0] * s[:, 1] - beta * s[:, 2]], 1)

    h = dt / parts
    for _ in range(parts):
        a = slope(x)
        b = slope(x + h / 2 * a)
        c = slope(x + h / 2 * b)
        d = slope(x + h * c)
        x = x + h / 6 * (a + 2 * b + 2 * c + d)
    return x


def lorenz() -> Model:
    return validate(Model(lambda x, _: lorenz_step(x), lambda x, _: x[:, :2], np.eye(3), np.eye(2), np.array([1.0, 0, 0]), 0.5 * np.eye(3)))


EXAMPLES: dict[str, Callable[[], Model | GeneralModel]] = {
    "constant_velocity": constant_velocity,
    "stable_linear": stable_linear,
    "random_walk": random_walk,
    "cube_root": cube_root,
    "cube_root_divisor": lambda: cube_root(divisor=True),
    "pendulum": pendulum,
    "sine_growth": sine_growth,
    "stochastic_volatility": stochastic_volatility,
    "lorenz": lorenz,
}
