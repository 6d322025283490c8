"""Repeatable randomness: md5-keyed Columns (the same in any SQL engine), keyed numpy streams, lattice points."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import Array


def uniform(*keys: Column | str | int) -> Column:
    """A uniform number in (0, 1) that depends on the keys alone (their text, joined by '|')."""
    parts = [F.lit(k).cast("string") if not isinstance(k, Column) else k.cast("string") for k in keys]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(*keys: Column | str | int) -> Column:
    """A standard normal number of the keys, by Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(*keys, "a"))) * F.cos(2 * F.pi() * uniform(*keys, "b"))


def uniform_sql(*keys: str) -> str:
    """The same uniform number as an expression of DuckDB's SQL over SQL expressions."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13) AS UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"


def normal_sql(*keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*keys, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(*keys, chr(39) + 'b' + chr(39))}))"


def stream(*keys: object) -> np.random.Generator:
    """A numpy generator of the keys alone, so that a retried task draws the same."""
    return np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(repr(keys).encode()).digest()[:16], "little")))


def lattice(n: int, dims: int, shift: Array | None = None) -> Array:
    """n points of a rank-1 Korobov lattice in [0, 1)**dims, shifted. The generator is the golden-section multiplier of n."""
    a = max(1, round(n * 0.6180339887498949))
    while np.gcd(a, n) != 1:
        a += 1
    z = np.ones(dims, dtype=object)
    for i in range(1, dims):
        z[i] = z[i - 1] * a % n
    points = np.outer(np.arange(n), z.astype(np.int64)) % n / n
    return (points + (0.5 / n if shift is None else shift)) % 1.0


def quasi_normals(n: int, dims: int, mean: Array | None = None, cov: Array | None = None, rng: np.random.Generator | None = None) -> Array:
    """Normals by Box-Muller from lattice points, in shuffled order if rng is given: (n, dims)."""
    pairs = (dims + 1) // 2
    u = lattice(n, 2 * pairs, None if rng is None else rng.random(2 * pairs))
    u = np.clip(u, 1e-12, 1 - 1e-12)
    radius = np.sqrt(-2 * np.log(u[:, :pairs]))
    z = np.concatenate([radius * np.cos(2 * np.pi * u[:, pairs:]), radius * np.sin(2 * np.pi * u[:, pairs:])], 1)[:, :dims]
    if rng is not None:
        z = z[rng.permutation(n)]
    if cov is not None:
        z = z @ np.linalg.cholesky(np.atleast_2d(cov)).T
    return z if mean is None else z + mean
