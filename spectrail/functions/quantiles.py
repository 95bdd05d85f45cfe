"""Quantiles of the distributions behind the limits, from the commons-math library that comes with Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(name: str, p: float, *parameters: float) -> float:
    spark = SparkSession.active()
    return float(getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, parameters)).inverseCumulativeProbability(float(p)))


def beta(p: float, a: float, b: float) -> float:
    return _of("BetaDistribution", p, a, b)


def f(p: float, d1: float, d2: float) -> float:
    return _of("FDistribution", p, d1, d2)


def chi2(p: float, df: float) -> float:
    return _of("ChiSquaredDistribution", p, df)


def normal(p: float) -> float:
    return _of("NormalDistribution", p, 0.0, 1.0)


def t2_limit(n: int, a: int, alpha: float = 0.05, new: bool = False) -> float:
    """Hotelling's limit for calibration rows (beta) or new ones (F)."""
    if n <= a + (not new):
        raise ValueError(f"no T2 limit for {n} samples and {a} components")
    if new:
        return a * (n * n - 1) / (n * (n - a)) * f(1 - alpha, a, n - a)
    return (n - 1) ** 2 / n * beta(1 - alpha, a / 2, (n - a - 1) / 2)


def spe_limit(eigenvalues, a: int, alpha: float = 0.05) -> float:
    """The residual limit of Jackson and Mudholkar from the eigenvalues after the first a."""
    rest = [float(v) for v in eigenvalues[a:]]
    if not rest:
        raise ValueError("no residual limit: every component is retained")
    t1, t2, t3 = (sum(v**k for v in rest) for k in (1, 2, 3))
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    inner = normal(1 - alpha) * (2 * t2 * h * h) ** 0.5 / t1 + 1 + t2 * h * (h - 1) / t1**2
    if inner <= 0:
        raise ValueError("no residual limit: the approximation has no real root")
    return t1 * inner ** (1 / h)


def spe_caveat(eigenvalues, a: int) -> str | None:
    """What must be said of ``spe_limit``: where its exponent isn't positive the approximation is used outside the range it was made for."""
    t1, t2, t3 = (sum(float(v) ** k for v in eigenvalues[a:]) for k in (1, 2, 3))
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2) if t2 else 1.0
    return f"the residual limit's exponent is {h:.3g}, not above zero: a few of the discarded components hold most of the residual, and the limit is a rough one" if h <= 0 else None


def moment_limit(values, alpha: float = 0.05) -> float:
    """Chi-squared with mean and variance of the residuals."""
    import numpy as np

    m, v = float(np.mean(values)), float(np.var(values, ddof=1))
    if v <= 0:
        raise ValueError("no residual limit: the residuals don't vary")
    return v / (2 * m) * chi2(1 - alpha, 2 * m * m / v)
