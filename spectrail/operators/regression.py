"""Regression estimators over fold factors: fits, cross-validated predictions, curves and tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions import quantiles
from spectrail.functions.arrays import Refused, dot, literal

from . import dual, kernels
from .factors import Fitted, fold_fits, training_sets

#: A fit gives coefficients of the centred variables, one row for each number of components or grid value.
Fit = Callable[[Fitted], np.ndarray]


def pls_path(components: int) -> Fit:
    def fit(m: Fitted) -> np.ndarray:
        model = kernels.pls(m.x, m.y[:, 0], components, m.n)
        return np.stack([model.coefficients(a) for a in range(1, components + 1)])

    return fit


def pcr_path(components: int) -> Fit:
    def fit(m: Fitted) -> np.ndarray:
        front, q = kernels.pcr(m.x, m.y[:, 0], components, m.n)
        return np.cumsum(front.loadings * q, axis=1).T

    return fit


def opls_path(orthogonal: int) -> Fit:
    """One row for 0, 1, ... orthogonal components; a later one that finds none repeats the row before."""
    return lambda m: np.stack([kernels.opls(m.x, m.y[:, 0], a, m.n)[0] for a in range(orthogonal + 1)])


def ridge_path(alphas: list[float]) -> Fit:
    return lambda m: np.stack([kernels.ridge(m.x, m.y[:, 0], a)[0] for a in alphas])


def elastic_net_path(alphas: list[float], l1_ratio: float = 0.5) -> Fit:
    """Largest alpha first, each from the one before; results in the order given."""

    def fit(m: Fitted) -> np.ndarray:
        gram, xy, out, b = m.x.T @ m.x, m.x.T @ m.y[:, 0], {}, None
        for a in sorted(set(alphas), reverse=True):
            b = out[a] = kernels.elastic_net(gram, xy, m.n, a, l1_ratio, b)
        return np.stack([out[a] for a in alphas])

    return fit


def mlr_fit(m: Fitted) -> np.ndarray:
    return kernels.mlr(m.x, m.y[:, 0], m.n)[None]


def ridge_grid(m: Fitted, points: int = 25) -> list[float]:
    """Six decades up to the squared spectral norm."""
    return (np.linalg.norm(m.x, 2) ** 2 * np.logspace(-6, 0, points)).tolist()


def elastic_net_grid(m: Fitted, l1_ratio: float = 0.5, points: int = 25) -> list[float]:
    """Three decades up to the least alpha that leaves no variable."""
    return (np.abs(m.x.T @ m.y[:, 0]).max() / (m.n * l1_ratio) * np.logspace(-3, 0, points)).tolist()


def cross_validated(df: DataFrame, y: str, fit: Fit, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, fold, y, yhat (an array, one value for each row of coefficients), each from the fit without the sample's fold.

    Centring is part of the fit.  The folds' coefficients go out with the
    scoring tasks; they don't grow with the samples.
    """
    found = fold_fits(df, [y], fit, fold, x)
    if len(found) < 2:
        raise Refused("cross-validation needs two folds or more")
    models = {k: (b, x_mean, float(y_mean[0])) for k, (b, x_mean, y_mean) in found.items()}
    shared = df.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            for k in pdf["fold"].unique():
                b, x_mean, y_mean = shared.value[k]
                at = np.flatnonzero(pdf["fold"] == k)
                values = (np.stack(pdf["x"].iloc[at].to_list()) - x_mean) @ b.T + y_mean
                for i, v in zip(at, values, strict=True):
                    out[i] = v
            yield pdf[["sample_idx", "fold", "y"]].assign(yhat=pd.Series(out, dtype=object, index=pdf.index))

    rows = df.select("sample_idx", F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), F.col(x).alias("x"))
    return rows.mapInPandas(score, "sample_idx bigint, fold int, y double, yhat array<double>")


def rmsecv_curve(df: DataFrame, y: str, fit: Fit, fold: str = "fold", x: str = "x") -> DataFrame:
    """a (from 1), rmsecv, q2: errors pooled over all held-out samples."""
    long = cross_validated(df, y, fit, fold, x).select("y", F.posexplode("yhat").alias("pos", "p"))
    e2 = (F.col("y") - F.col("p")) ** 2
    return long.groupBy((F.col("pos") + 1).alias("a")).agg(F.sqrt(F.avg(e2)).alias("rmsecv"), (1 - F.sum(e2) / (F.var_pop("y") * F.count("y"))).alias("q2"))


def predict(df: DataFrame, b: np.ndarray, x_mean: np.ndarray, y_mean: float, x: str = "x") -> DataFrame:
    """The rows with column p, a pure column expression."""
    return df.withColumn("p", dot(F.col(x), literal(b)) + F.lit(float(y_mean - x_mean @ b)))


def pls_explained(df: DataFrame, y: str, components: int, x: str = "x") -> DataFrame:
    """a (from 1), x and y: shares of the total sum of squares that each component explains, and x_total and y_total, those of all up to it."""
    model, m = _whole_pls(df, y, components, x)
    share_x = model.t_size * (model.p**2).sum(0) / (m.x * m.x).sum()
    share_y = model.t_size * model.q**2 / (m.y * m.y).sum()
    rows = zip(range(1, len(share_x) + 1), share_x.tolist(), share_y.tolist(), np.cumsum(share_x).tolist(), np.cumsum(share_y).tolist(), strict=True)
    return df.sparkSession.createDataFrame(list(rows), "a int, x double, y double, x_total double, y_total double")


def _whole_pls(df: DataFrame, y: str, components: int, x: str) -> tuple[kernels.Latent, Fitted]:
    m, _ = training_sets(df.withColumn("_all", F.lit(0)), [y], "_all", x)
    return kernels.pls(m.x, m.y[:, 0], components, m.n), m


def pls_distances(df: DataFrame, y: str, components: int, x: str = "x", alpha: float = 0.05) -> DataFrame:
    """sample_idx, t2, t2_limit, spe, spe_limit of each row in the components of partial least squares.

    The limit of spe is that of a chi-squared variable with the mean and the
    variance (n - 1) of the rows' values, two sums of another pass; residuals
    that are rounding noise of the variables have no limit and are refused.
    """
    model, m = _whole_pls(df, y, components, x)
    rotations, loadings, spread = model.rotations, model.p, model.t_size / (m.n - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.stack(pdf["x"].to_list()).astype(float) - m.x_mean if len(pdf) else np.zeros((0, len(m.x_mean)))
            t = c @ rotations
            e = c - t @ loadings.T
            yield pdf[["sample_idx"]].assign(t2=(t**2 / spread).sum(1), spe=(e * e).sum(1))

    rows = df.select("sample_idx", F.col(x).alias("x")).mapInPandas(run, "sample_idx bigint, t2 double, spe double")
    got = rows.agg(F.avg("spe").alias("m"), F.var_samp("spe").alias("v")).first()
    if not got["v"] or got["m"] * m.n <= (kernels.STORED_EPS * max(m.x.shape[1], 1)) ** 2 * (m.x * m.x).sum():
        raise Refused("no residual limit: what the components leave is rounding noise")
    spe_top = quantiles.chi2(1 - alpha, 2 * got["m"] ** 2 / got["v"]) * got["v"] / (2 * got["m"])
    return rows.select("sample_idx", "t2", F.lit(quantiles.t2_limit(m.n, len(spread), alpha)).alias("t2_limit"), "spe", F.lit(float(spe_top)).alias("spe_limit"))


def svr_machines(df: DataFrame, y: str, components: int, fold: str = "fold", x: str = "x") -> tuple[DataFrame, dict[int, float]]:
    """``sample_idx, machine, t, learns, y``, each row once for every fold, on component scores refitted without it; and each fold's usual gamma."""
    _, folds = training_sets(df, [y], fold, x)
    if not folds:
        raise Refused("cross-validation needs two folds or more")
    fronts, gamma = {}, {}
    for k, m in folds.items():
        model = kernels.pca(m.x, components, m.n, 0.0)
        fronts[k] = model.loadings, m.x_mean
        gamma[k] = 1 / float(model.eigenvalues[:components].sum() * (m.n - 1) / m.n)

    @F.pandas_udf("array<double>")
    def scores(rows: pd.Series, out: pd.Series) -> pd.Series:
        found: list = [None] * len(rows)
        for k in out.unique():
            at = np.flatnonzero(out == k)
            for i, t in zip(at, (np.stack(rows.iloc[at].to_list()).astype(float) - fronts[k][1]) @ fronts[k][0], strict=True):
                found[i] = t
        return pd.Series(found, dtype=object, index=rows.index)

    each = df.select("sample_idx", F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), F.col(x).alias("x"), F.explode(F.lit([int(k) for k in fronts])).alias("machine"))
    return each.select("sample_idx", "machine", scores("x", "machine").alias("t"), (F.col("fold") != F.col("machine")).alias("learns"), "y"), gamma


def svr(df: DataFrame, y: str, components: int, c: float = 1.0, epsilon: float = 0.1, kind: str = "rbf", gamma: float | None = None, fold: str = "fold", x: str = "x", tol: float = 1e-3) -> DataFrame:
    """sample_idx, fold, y, p: epsilon-insensitive regression on component scores, refitted without each fold; the response isn't centred."""
    rows, usual = svr_machines(df, y, components, fold, x)
    ((_, solved),) = dual.svr_path(rows, "y", [c], kind, {k: gamma or g for k, g in usual.items()}, epsilon, tol)
    return solved.decided().where("asked and not learns").select("sample_idx", F.col("machine").alias("fold"), "y", F.col("decision").alias("p"))


def svr_curve(df: DataFrame, y: str, components: int, epsilon: float = 0.1, kind: str = "rbf", gamma: float | None = None, points: int = 13, fold: str = "fold", x: str = "x", tol: float = 1e-3) -> DataFrame:
    """c, rmsecv, q2 over bounds in three decades up to the response's range (``points`` of them)."""
    span = df.agg((F.max(y) - F.min(y)).cast("double")).first()[0]
    if not span:
        raise Refused("a response without range has no grid of bounds")
    rows, usual = svr_machines(df, y, components, fold, x)
    return dual.svr_curve(rows, "y", (span * np.logspace(-3, 0, points)).tolist(), kind, {k: gamma or g for k, g in usual.items()}, epsilon, tol)
