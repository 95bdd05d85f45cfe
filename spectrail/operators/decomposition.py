"""Principal components of a table: fitted from its R factor, applied as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import dot, literal
from spectrail.functions.quantiles import spe_limit, t2_limit

from . import kernels
from .factors import factor, fold_factors, training_sets


def fit_pca(df: DataFrame, components: int, x: str = "x", centre: bool = True) -> tuple[kernels.Pca, np.ndarray]:
    """The model and the means it was centred on (zeros if not)."""
    keyed = df.withColumn("_fold", F.lit(0)).withColumn("_y", F.lit(0.0))
    whole, _ = training_sets(keyed, ["_y"], "_fold", x)
    if centre:
        return kernels.pca(whole.x, components, whole.n), whole.x_mean
    raw = np.linalg.qr(np.concatenate([whole.x, np.sqrt(whole.n) * whole.x_mean[None]]), mode="r")
    return kernels.pca(raw, components, whole.n), np.zeros_like(whole.x_mean)


def with_scores(df: DataFrame, model: kernels.Pca, mean: np.ndarray, x: str = "x") -> DataFrame:
    """Scores t, Hotelling's t2 and the squared residual spe of each row."""
    centred = F.zip_with(x, literal(mean), lambda v, m: v - m)
    out = df.withColumn("_c", centred).withColumn("t", F.array(*[dot(F.col("_c"), literal(p)) for p in model.loadings.T]))
    t2 = sum((F.get("t", F.lit(a)) ** 2 / float(v) for a, v in enumerate(model.eigenvalues[: model.loadings.shape[1]])), F.lit(0.0))
    spe = F.greatest(dot(F.col("_c"), F.col("_c")) - dot(F.col("t"), F.col("t")), F.lit(0.0))
    return out.withColumns({"t2": t2, "spe": spe}).drop("_c")


def limits(model: kernels.Pca, alpha: float = 0.05, new: bool = False) -> dict[str, float]:
    a = model.loadings.shape[1]
    return {"t2": t2_limit(model.n, a, alpha, new), "spe": spe_limit(model.eigenvalues, a, alpha) if a < len(model.eigenvalues) else 0.0}


@dataclass
class Group:
    """Rows of one class: their number and the R factor of [1, X]."""

    n: int
    r: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.r[0, 1:] / self.r[0, 0]

    @property
    def centred(self) -> np.ndarray:
        return self.r[1:, 1:]


def class_models(df: DataFrame, label: str, x: str = "x") -> dict[object, Group]:
    """The rows of every class from one pass; rows without a label are left out."""
    names = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # classes are few
    coded = df.where(F.col(label).isNotNull()).withColumn("_class", F.array_position(F.lit(names), F.col(label)).cast("int") - 1)
    found = {r.fold: Group(*factor(r, 0)) for r in fold_factors(coded, [], "_class", x).collect()}
    return {name: found[k] for k, name in enumerate(names)}


def row_distances(rows: np.ndarray, mean: np.ndarray, model: kernels.Pca) -> tuple[np.ndarray, np.ndarray]:
    """t2 and spe of each row."""
    c = rows - mean
    t = c @ model.loadings
    return (t**2 / model.eigenvalues[: t.shape[1]]).sum(1), np.maximum((c * c).sum(1) - (t * t).sum(1), 0)


def contributions(df: DataFrame, model: kernels.Pca, mean: np.ndarray, x: str = "x") -> DataFrame:
    """sample_idx, var_idx, t2_part (they sum to t2), residual and its square: two matrix products a block of rows."""
    a = model.loadings.shape[1]
    loadings, scaled = model.loadings, model.loadings / model.eigenvalues[:a]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                c = np.stack(part["x"].to_list()).astype(float) - mean
                yield pd.DataFrame({"sample_idx": part["sample_idx"], "t2_part": list(c * (c @ scaled @ loadings.T)), "residual": list(c - c @ loadings @ loadings.T)})

    rows = df.select("sample_idx", F.col(x).alias("x")).mapInPandas(run, "sample_idx bigint, t2_part array<double>, residual array<double>")
    long = rows.select("sample_idx", F.posexplode(F.arrays_zip("t2_part", "residual")).alias("var_idx", "p"))
    return long.select("sample_idx", "var_idx", "p.t2_part", "p.residual", (F.col("p.residual") ** 2).alias("residual2"))
