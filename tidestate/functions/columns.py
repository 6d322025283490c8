"""Column builders: densities, compat moments, shuffles, cubature rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rand import uniform


def normal_pdf(x: Column, mean: Column | float, var: Column | float) -> Column:
    e = x - mean
    return F.exp(-0.5 * e * e / var) / F.sqrt(2 * F.pi() * F.lit(1.0) * var)


def mvn_logpdf(x: Sequence[Column], mean: Sequence[float], cov: Sequence[Sequence[float]]) -> Column:
    """Log density of a few columns under a constant normal; precision and determinant are literals."""
    cov = np.asarray(cov, float)
    precision, d = np.linalg.inv(cov), [c - m for c, m in zip(x, mean, strict=True)]
    form = sum((F.lit(float(precision[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.lit(-0.5 * float(np.log(np.linalg.det(2 * np.pi * cov)))) - 0.5 * form


def mvn_pdf(x: Sequence[Column], mean: Sequence[float], cov: Sequence[Sequence[float]]) -> Column:
    return F.exp(mvn_logpdf(x, mean, cov))


def compat_covariance(w: Column, x: Column) -> Column:
    """The sample variance of weight-scaled particles, as the engine we match reports it."""
    return F.var_samp(w * x)


def shuffled(*keys: Column | str | int) -> Column:
    """A sort key that puts rows in a random order of the keys alone."""
    return uniform("shuffle", *keys)


def cubature(spark: SparkSession, low: Sequence[float], high: Sequence[float], points: int = 64, panels: int = 16) -> DataFrame:
    """Nodes x (array) and weights w of a composite tensor Gauss-Legendre rule over a box: integrals are sums of w * f(x)."""
    z, w = np.polynomial.legendre.leggauss(points)
    out = spark.range(1).select(F.array().cast("array<double>").alias("x"), F.lit(1.0).alias("w"))
    for a, b in zip(low, high, strict=True):
        edge = np.linspace(a, b, panels + 1)
        rows = [(float((p + q) / 2 + (q - p) / 2 * zi), float(wi * (q - p) / 2)) for p, q in zip(edge[:-1], edge[1:], strict=True) for zi, wi in zip(z, w, strict=True)]
        nodes = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(v).alias("w")) for x, v in rows]))
        out = out.withColumn("node", nodes).select(F.concat("x", F.array("node.x")).alias("x"), (F.col("w") * F.col("node.w")).alias("w"))
    return out
