"""Particle filters on numpy arrays: one series, n particles as rows.

Every step returns a Step: the particles before resampling with their normalised weights and the
ancestors drawn, so that particles and weights always belong together. Weights are kept as logarithms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.density import ess, mvn_logpdf, normalise, weighted_moments
from ..functions.linalg import Array, noise_covariance, principal_sqrt
from ..functions.rand import quasi_normals
from ..models import GeneralModel, Model
from .gaussian import Unscented


@dataclass
class Step:
    x: Array  # (n, d) before resampling
    w: Array  # (n,) normalised
    ancestors: Array  # (n,) indices into x for the next step
    loglik: float
    parents: Array  # (n,) indices of the last step's particles that x was moved from
    cov: Array | None = None  # (n, d, d) of filters that carry one

    @property
    def mean(self) -> Array:
        return weighted_moments(self.x, self.w)[0]

    @property
    def spread(self) -> Array:
        return weighted_moments(self.x, self.w)[1]

    @property
    def ess(self) -> float:
        return ess(self.w)

    @property
    def resampled(self) -> Array:
        return self.x[self.ancestors]


# resampling


def multinomial(w: Array, rng: np.random.Generator) -> Array:
    return np.minimum(np.searchsorted(np.cumsum(w), np.sort(rng.random(len(w))), "right"), len(w) - 1)


def stratified(w: Array, rng: np.random.Generator) -> Array:
    """One uniform number in each of n strata; the last sum is taken as 1."""
    n = len(w)
    return np.minimum(np.searchsorted(np.cumsum(w), (np.arange(n) + rng.random(n)) / n, "right"), n - 1)


def systematic(w: Array, rng: np.random.Generator) -> Array:
    n = len(w)
    return np.minimum(np.searchsorted(np.cumsum(w), (np.arange(n) + rng.random()) / n, "right"), n - 1)


# parts of steps


def prior(model: Model | GeneralModel, n: int, rng: np.random.Generator) -> Array:
    return rng.multivariate_normal(model.m0, model.P0, n)


def noise(cov: Array, n: int, rng: np.random.Generator, quasi: bool = False) -> Array:
    """n draws of N(0, cov), from a shuffled lattice if quasi."""
    if quasi:
        return quasi_normals(n, len(cov), rng=rng) @ principal_sqrt(cov).T
    return rng.standard_normal((n, len(cov))) @ principal_sqrt(cov).T


def moved(model: Model | GeneralModel, x: Array, rng: np.random.Generator, quasi: bool = False) -> Array:
    q = noise(model.Q, len(x), rng, quasi)
    return model.step(x) + q if isinstance(model, Model) else model.f(x, q)


def slopes(f: Callable[[Array], Array], at: Array, step: float = 1e-6) -> Array:
    """Central differences of f, which maps rows to rows, at each row of `at`: (n, outputs, inputs)."""
    cols = []
    for i in range(at.shape[1]):
        h = step * np.maximum(1.0, np.abs(at[:, i]))
        up, down = at.copy(), at.copy()
        up[:, i] += h
        down[:, i] -= h
        cols.append((f(up) - f(down)) / (2 * h)[:, None])
    return np.stack(cols, -1)


def each_logpdf(d: Array, cov: Array) -> Array:
    """Log density of each row of d under N(0, cov) of its own."""
    if d.shape[1] == 1:
        v = cov[:, 0, 0]
        return -0.5 * (d[:, 0] * d[:, 0] / v + np.log(2 * np.pi * v))
    _, logdet = np.linalg.slogdet(cov)
    return -0.5 * (np.einsum("ni,ni->n", d, np.linalg.solve(cov, d[..., None])[..., 0]) + logdet + d.shape[1] * np.log(2 * np.pi))


def log_weights(model: Model | GeneralModel, x: Array, y: Array, compat: bool = False) -> Array:
    """Log density of y at each particle; zeros without an observation. General models' noise is linearised at each particle."""
    if np.isnan(y).any():
        return np.zeros(len(x))
    if isinstance(model, Model):
        return mvn_logpdf(np.broadcast_to(y, (len(x), len(y))), model.observe(x), model.R)
    none = np.zeros((len(x), len(model.R)))
    return each_logpdf(y - model.g(x, none), observation_covariances(model, x, len(y), compat))


def observation_covariances(model: GeneralModel, x: Array, width: int, compat: bool = False) -> Array:
    """The observation's noise covariance at each particle, its two noise terms linearised at 0."""
    none = np.zeros((len(x), len(model.R)))
    add, mul = (slopes(lambda r, h=h: h(x, r, model.theta), none) for h in (model.add_g, model.mul_g))
    return noise_covariance(add, mul, model.R, compat) + 1e-300 * np.eye(width)


def _closed(x: Array, log_w: Array, parents: Array, rng: np.random.Generator, resample: Callable, cov: Array | None = None) -> Step:
    w, ll = normalise(log_w)
    return Step(x, w, resample(w, rng), ll, parents, cov)


# filters: functions of (model, resampled particles, y, rng, state of the last step)


def bootstrap(model: Model | GeneralModel, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None, quasi: bool = False, resample: Callable = multinomial) -> Step:
    x = moved(model, x, rng, quasi)
    return _closed(x, log_weights(model, x, y), np.arange(len(x)), rng, resample)


def quasi_bootstrap(model: Model | GeneralModel, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None) -> Step:
    return bootstrap(model, x, y, rng, last, True)


def _look_ahead(model: Model | GeneralModel, x: Array) -> Array:
    return model.step(x) if isinstance(model, Model) else model.f(x, np.zeros((len(x), len(model.Q))))


def auxiliary(model: Model | GeneralModel, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None) -> Step:
    """First-stage weights at the predicted states; second-stage weights correct for them. The likelihood is the product of both stages' means."""
    first = log_weights(model, _look_ahead(model, x), y)
    w, ll1 = normalise(first)
    parents = multinomial(w, rng)
    new = moved(model, x[parents], rng)
    step = _closed(new, log_weights(model, new, y) - first[parents], parents, rng, multinomial)
    step.loglik += ll1
    return step


#: From so many particles of one dimension on, sums of normal densities are taken by series; the terms of each.
BY_SERIES, TERMS = 600, 24


def gauss_sums(at: Array, centre: Array, w: Array) -> Array:
    """Sums over j of w[j, k] exp(-(at[i] - centre[j])**2 / 2), (len(at), k), to about twelve digits: centres and places are taken by cells of width 1, whose
    Hermite series are turned into Taylor series around the cells of the places (a fast Gauss transform)."""
    cells, which = np.unique(np.floor(centre), return_inverse=True)
    places, here = np.unique(np.floor(at), return_inverse=True)
    off, by = centre - cells[which] - 0.5, at - places[here] - 0.5
    power, a = np.ones(len(off)), np.empty((TERMS, len(cells), w.shape[1]))
    for k in range(TERMS):
        for i in range(w.shape[1]):
            a[k, :, i] = np.bincount(which, power * w[:, i], len(cells))
        power = power * off / (k + 1)
    z = places[:, None] - cells[None]
    h = np.empty((2 * TERMS, *z.shape))
    h[0] = np.exp(-0.5 * z * z)
    h[1] = z * h[0]
    for k in range(2, 2 * TERMS):
        h[k] = z * h[k - 1] - (k - 1) * h[k - 2]
    local = np.stack([(-1) ** m * np.einsum("kpc,kci->pi", h[m : m + TERMS], a, optimize=True) for m in range(TERMS)])
    out = local[TERMS - 1][here]
    for m in range(TERMS - 2, -1, -1):
        out = local[m][here] + out * (by / (m + 1))[:, None]
    return np.maximum(out, 0.0)


def improved_auxiliary(model: Model, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None) -> Step:
    """Weights of both stages are ratios of mixtures over all parents (n**2 densities, in blocks of rows, or by gauss_sums).

    Parents weigh alike, as they were resampled: the first stage's ratio of mixtures is the same for all.
    """
    n = len(x)
    centre = model.step(x)
    unwhite = np.linalg.inv(np.linalg.cholesky(model.Q)).T
    white = centre @ unwhite

    def mixtures(at: Array, w: Array) -> Array:
        at = at @ unwhite
        if at.shape[1] == 1 and n >= BY_SERIES:
            return gauss_sums(at[:, 0], white[:, 0], w)
        out = np.empty((len(at), w.shape[1]))
        rows = max(1, (1 << 17) // n)
        for a in range(0, len(at), rows):
            d = np.zeros((len(at[a : a + rows]), n))
            for i in range(at.shape[1]):
                e = at[a : a + rows, None, i] - white[None, :, i]
                e *= e
                d -= e
            d *= 0.5
            out[a : a + rows] = np.exp(d, out=d) @ w
        return out

    lam, _ = normalise(log_weights(model, centre, y))
    parents = stratified(lam, rng)
    new = moved(model, x[parents], rng)
    both = np.log(np.maximum(mixtures(new, np.stack([np.full(n, 1 / n), lam], 1)), 1e-300))
    return _closed(new, log_weights(model, new, y) + both[:, 0] - both[:, 1], parents, rng, stratified)


def _proposed(model: Model, x: Array, mean: Array, cov: Array, y: Array, rng: np.random.Generator) -> Step:
    """Draws from each particle's Gaussian proposal, whose covariance it carries on, and weighs by likelihood, transition and proposal."""
    cov = (cov + np.swapaxes(cov, 1, 2)) / 2
    new = mean + np.einsum("nij,nj->ni", principal_sqrt(cov), rng.standard_normal(x.shape))
    lw = log_weights(model, new, y) + mvn_logpdf(new, model.step(x), model.Q) - each_logpdf(new - mean, cov)
    return _closed(new, lw, np.arange(len(x)), rng, multinomial, cov)


def _covs(model: Model, n: int, last: Step | None) -> Array:
    return np.repeat(np.asarray(model.P0, float)[None], n, 0) if last is None or last.cov is None else last.cov[last.ancestors]


def sir_extended(model: Model, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None) -> Step:
    """Proposals by an extended Kalman filter at each particle, all at once."""
    if np.isnan(y).any():
        return bootstrap(model, x, y, rng)
    p = _covs(model, len(x), last)
    f = slopes(model.step, x)
    m, c = model.step(x), f @ p @ np.swapaxes(f, 1, 2) + model.Q
    h = slopes(model.observe, m)
    s = h @ c @ np.swapaxes(h, 1, 2) + model.R
    gain = np.swapaxes(np.linalg.solve(s, h @ c), 1, 2)
    return _proposed(model, x, m + np.einsum("nij,nj->ni", gain, y - model.observe(m)), c - gain @ s @ np.swapaxes(gain, 1, 2), y, rng)


def sir_unscented(model: Model, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None, ut: Unscented = Unscented()) -> Step:
    """Proposals by an unscented Kalman filter at each particle, all at once."""
    if np.isnan(y).any():
        return bootstrap(model, x, y, rng)
    n, d = x.shape
    wm, wc = ut.weights(d)
    width = np.sqrt(d + ut.spread(d))

    def points(m: Array, p: Array) -> Array:
        half = width * np.swapaxes(principal_sqrt(p), 1, 2)
        return np.concatenate([m[:, None], m[:, None] + half, m[:, None] - half], 1)

    def through(f: Callable[[Array], Array], z: Array) -> tuple[Array, Array, Array]:
        out = f(z.reshape(-1, d)).reshape(n, 2 * d + 1, -1)
        mean = np.einsum("k,nki->ni", wm, out)
        dev = out - mean[:, None]
        return mean, dev, np.einsum("k,nki,nkj->nij", wc, dev, dev)

    m, _, c = through(model.step, points(x, _covs(model, n, last)))
    c = c + model.Q
    z = points(m, c)
    mu, dev, s = through(model.observe, z)
    s = s + model.R
    cross = np.einsum("k,nki,nkj->nij", wc, z - m[:, None], dev)
    gain = np.swapaxes(np.linalg.solve(s, np.swapaxes(cross, 1, 2)), 1, 2)
    return _proposed(model, x, m + np.einsum("nij,nj->ni", gain, y - mu), c - gain @ s @ np.swapaxes(gain, 1, 2), y, rng)


def step_covariances(model: GeneralModel, x: Array, compat: bool = False) -> Array:
    """The transition's noise covariance at each particle, its two noise terms linearised at 0."""
    none = np.zeros((len(x), len(model.Q)))
    add, mul = (slopes(lambda e, h=h: h(x, e, model.theta), none) for h in (model.add_f, model.mul_f))
    return noise_covariance(add, mul, model.Q, compat) + 1e-12 * np.eye(model.dim)


def step_logpdf(model: Model | GeneralModel, before: Array, after: Array) -> Array:
    """Log density of each row of `after` given that of `before`."""
    if isinstance(model, Model):
        return mvn_logpdf(after, model.step(before), model.Q)
    return each_logpdf(after - _look_ahead(model, before), step_covariances(model, before))


def first_logpdf(model: Model, x: Array) -> Array:
    """Log density of states after the first step, which moves the prior: N(f(m0), F P0 F' + Q)."""
    f = slopes(model.step, np.atleast_2d(np.asarray(model.m0, float)))[0]
    return mvn_logpdf(x, np.broadcast_to(model.step(model.m0), x.shape), f @ model.P0 @ f.T + model.Q)


def sir_extended_general(model: GeneralModel, x: Array, y: Array, rng: np.random.Generator, last: Step | None = None, compat: bool = False) -> Step:
    """Proposals for general noise: an extended Kalman filter at each particle, its covariance carried on, linearised in state and noise.

    Weights are transition times likelihood over proposal, in log space. compat: pure noise terms are counted twice and y's covariance is that at the particle moved from.
    """
    if np.isnan(y).any():
        return bootstrap(model, x, y, rng)
    n = len(x)
    no_q, no_r = np.zeros((n, len(model.Q))), np.zeros((n, len(model.R)))
    ahead = model.f(x, no_q)
    f, l = slopes(lambda v: model.f(v, no_q), x), slopes(lambda e: model.f(x, e), no_q)
    c = f @ _covs(model, n, last) @ np.swapaxes(f, 1, 2) + l @ model.Q @ np.swapaxes(l, 1, 2)
    h, v = slopes(lambda z: model.g(z, no_r), ahead), slopes(lambda e: model.g(ahead, e), no_r)
    s = h @ c @ np.swapaxes(h, 1, 2) + v @ model.R @ np.swapaxes(v, 1, 2) + 1e-12 * np.eye(len(y))
    gain = np.swapaxes(np.linalg.solve(s, h @ c), 1, 2)
    mean = ahead + np.einsum("nij,nj->ni", gain, y - model.g(ahead, no_r))
    cov = c - gain @ s @ np.swapaxes(gain, 1, 2)
    cov = (cov + np.swapaxes(cov, 1, 2)) / 2 + 1e-12 * np.eye(model.dim)
    new = mean + np.einsum("nij,nj->ni", principal_sqrt(cov), rng.standard_normal(x.shape))
    seen = log_weights(model, new, y) if not compat else each_logpdf(y - model.g(new, no_r), observation_covariances(model, x, len(y), True))
    lw = seen + each_logpdf(new - ahead, step_covariances(model, x, compat)) - each_logpdf(new - mean, cov)
    return _closed(new, lw, np.arange(n), rng, multinomial, cov)


def mh_moves(model: Model, paths: Array, ys: Array, rng: np.random.Generator, lag: int = 5, moves: int = 1, scale: float = 2.0) -> tuple[Array, Array]:
    """Metropolis-Hastings on the last `lag` states of each path (n, T, d): random walks of the given scale. Paths and accepted counts.

    Paths begin with the state after the first step, whose density is that of the prior moved once.
    """
    paths = paths.copy()
    lag = min(lag, paths.shape[1])
    accepted = np.zeros(len(paths), int)

    def score(p: Array) -> Array:
        out = np.zeros(len(p))
        for t in range(p.shape[1] - lag, p.shape[1]):
            out += (step_logpdf(model, p[:, t - 1], p[:, t]) if t else first_logpdf(model, p[:, 0])) + log_weights(model, p[:, t], ys[t])
        return out

    now = score(paths)
    for _ in range(moves):
        other = paths.copy()
        other[:, -lag:] += scale * rng.standard_normal(other[:, -lag:].shape) * np.sqrt(np.diag(model.Q))
        new = score(other)
        ok = np.log(rng.random(len(paths))) <= new - now
        paths[ok], now[ok] = other[ok], new[ok]
        accepted += ok
    return paths, accepted


FILTERS: dict[str, Callable] = {
    "bootstrap": bootstrap,
    "quasi_bootstrap": quasi_bootstrap,
    "auxiliary": auxiliary,
    "improved_auxiliary": improved_auxiliary,
    "sir_extended": sir_extended,
    "sir_extended_general": sir_extended_general,
    "sir_unscented": sir_unscented,
}


def run(model: Model | GeneralModel, ys: Array, n: int, rng: np.random.Generator, method: str = "bootstrap") -> list[Step]:
    """Filters one series (T, dy); rows of NaN are steps without observation."""
    x, last, out = prior(model, n, rng), None, []
    for y in ys:
        last = FILTERS[method](model, x, y, rng, last)
        out.append(last)
        x = last.resampled
    return out


def run_resample_move(model: Model, ys: Array, n: int, rng: np.random.Generator, lag: int = 5, moves: int = 1) -> tuple[list[Step], Array]:
    """Bootstrap steps whose resampled paths are then moved by mh_moves. Steps and paths (n, T, d)."""
    x, paths, out = prior(model, n, rng), np.empty((n, 0, model.dim)), []
    for t, y in enumerate(ys):
        step = bootstrap(model, x, y, rng)
        paths = np.concatenate([paths, step.x[:, None]], 1)[step.ancestors]
        paths, _ = mh_moves(model, paths, ys[: t + 1], rng, lag, moves)
        x = paths[:, -1]
        out.append(step)
    return out, paths


def loglik(steps: list[Step]) -> float:
    return float(sum(s.loglik for s in steps))


def energy(steps: list[Step]) -> Array:
    """Running sum of negative log likelihoods."""
    return -np.cumsum([s.loglik for s in steps])


def genealogy(steps: list[Step]) -> tuple[Array, Array]:
    """Particles (T, n, d), and ancestors[t, i]: the particle of step t - 1 behind particle i of t."""
    x = np.stack([s.x for s in steps])
    anc = np.zeros(x.shape[:2], int)
    for t in range(1, len(steps)):
        anc[t] = steps[t - 1].ancestors[steps[t].parents]
    return x, anc
