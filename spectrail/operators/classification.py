"""Classifiers.  Classes are taken in Unicode order, and ties go to the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused, block, dot, literal

from . import dual, kernels
from .decomposition import class_models, fit_pca, limits, row_distances, with_scores
from .factors import training_sets


def classes_of(df: DataFrame, label: str) -> list:
    """The distinct labels in order; fewer than two are refused."""
    out = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    if len(out) < 2:
        raise Refused(f"column {label} has fewer than two classes")
    return out


def check_folds(df: DataFrame, label: str, fold: str = "fold") -> None:
    """Refuses a fold whose training rows are all of one class."""
    total = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    held = df.groupBy(fold, label).count().collect()
    for k in {r[0] for r in held}:
        left = {c: n - sum(r["count"] for r in held if r[0] == k and r[1] == c) for c, n in total.items()}
        if sum(n > 0 for n in left.values()) < 2:
            raise Refused(f"fold {k} trains on one class only")


def first_largest(scores: Column) -> Column:
    """Position, from 0, of the first largest element."""
    return F.array_position(scores, F.array_max(scores)) - 1


def pls_da(df: DataFrame, label: str, components: int, x: str = "x") -> DataFrame:
    """observed, predicted and scores: PLS on 0/1 (two classes, cut at 0.5) or on one column a class (largest)."""
    classes = classes_of(df, label)
    targets = [f"_y{k}" for k in range(1 if len(classes) == 2 else len(classes))]
    coded = df.withColumns({t: (F.col(label) == F.lit(classes[1 if len(classes) == 2 else k])).cast("double") for k, t in enumerate(targets)}).withColumn("_fold", F.lit(0))
    m, _ = training_sets(coded, targets, "_fold", x)
    b = kernels.pls(m.x, m.y[:, 0] if len(targets) == 1 else m.y, components, m.n).coefficients().reshape(len(m.x_mean), -1)
    scores = F.array(*[dot(F.col(x), literal(b[:, k])) + F.lit(float(m.y_mean[k] - m.x_mean @ b[:, k])) for k in range(len(targets))])
    out = df.withColumn("scores", scores)
    pick = F.when(F.get("scores", F.lit(0)) >= 0.5, 1).otherwise(0) if len(targets) == 1 else first_largest(F.col("scores"))
    return out.select("sample_idx", F.col(label).alias("observed"), F.get(F.lit(classes), pick.cast("int")).alias("predicted"), "scores")


def _moments(df: DataFrame, label: str, components: int) -> dict:
    """n, mean and scatter of the scores t of each class; their size depends on classes and components only."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    t = lambda i: F.get("t", F.lit(i))
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(t(i)).alias(f"m{i}") for i in range(components)], *[F.covar_pop(t(i), t(j)).alias(f"c{i}_{j}") for i, j in pairs]).orderBy(label).collect()
    out = {}
    for r in rows:
        cov = np.zeros((components, components))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r[0]] = (r["n"], np.array([r[f"m{i}"] for i in range(components)]), cov * r["n"])
    return out


def discriminant(df: DataFrame, label: str, components: int, quadratic: bool = False, reg: float = 0.0, x: str = "x") -> DataFrame:
    """Linear or quadratic discriminant on component scores, priors as found: sample_idx, observed, predicted, scores."""
    classes_of(df, label)
    scored = with_scores(df, *fit_pca(df, components, x), x)
    groups = _moments(scored, label, components)
    n = sum(g[0] for g in groups.values())
    if not quadratic:
        if n - len(groups) < components:
            raise Refused(f"{n} samples of {len(groups)} classes leave too few degrees of freedom")
        pooled = np.linalg.pinv(sum(g[2] for g in groups.values()) / (n - len(groups)))
    parts = []
    for name, (size, mean, scatter) in groups.items():
        if quadratic:
            values, vectors = np.linalg.eigh(scatter / max(size - 1, 1))
            values = (1 - reg) * values + reg
            if size <= 1 or values.min() <= 1e-12 * values.max():
                raise Refused(f"the covariance of class {name} is singular")
            inverse, constant = vectors / values @ vectors.T, -0.5 * np.log(values).sum()
        else:
            inverse, constant = pooled, 0.0
        d = [F.get("t", F.lit(i)) - float(mean[i]) for i in range(components)]
        form = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(components) for j in range(components)), F.lit(0.0))
        parts.append(-0.5 * form + F.lit(float(constant + np.log(size / n))))
    out = scored.withColumn("scores", F.array(*parts))
    return out.select("sample_idx", F.col(label).alias("observed"), F.get(F.lit(list(groups)), first_largest(F.col("scores")).cast("int")).alias("predicted"), "scores")


def simca(df: DataFrame, label: str, components: int, x: str = "x", alpha: float = 0.05) -> DataFrame:
    """sample_idx, observed, model, t2, spe, h, accepted: every sample against a component model of each class.

    One pass for all classes' R factors, one for the scores against all of them.
    """
    classes_of(df, label)
    models = []
    for name, g in class_models(df, label, x).items():
        model = kernels.pca(g.centred, components, g.n)
        models.append((name, g.mean, model, limits(model, alpha, new=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.stack(pdf["x"].to_list()).astype(float) if len(pdf) else np.zeros((0, len(models[0][1])))
            for name, mean, model, top in models:
                t2, spe = row_distances(rows, mean, model)
                h = np.maximum(t2 / top["t2"], spe / top["spe"] if top["spe"] else 0.0)
                yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "observed": pdf["observed"], "model": name, "t2": t2, "spe": spe, "h": h, "accepted": h <= 1})

    kind = dict(df.dtypes)[label]
    rows = df.select("sample_idx", F.col(label).alias("observed"), F.col(x).alias("x"))
    return rows.mapInPandas(run, f"sample_idx bigint, observed {kind}, model {kind}, t2 double, spe double, h double, accepted boolean")


def simca_table(decided: DataFrame) -> DataFrame:
    """observed, model, n accepted; model null counts samples that no model accepts."""
    per = decided.groupBy("observed", "model").agg(F.sum(F.col("accepted").cast("bigint")).alias("n"))
    none = decided.groupBy("sample_idx", "observed").agg(F.max("accepted").alias("any")).groupBy("observed").agg(F.sum((~F.col("any")).cast("bigint")).alias("n"))
    return per.unionByName(none.withColumn("model", F.lit(None).cast(dict(per.dtypes)["model"])).select("observed", "model", "n"))


def score_variance(model: kernels.Pca) -> float:
    """The variance of all score values of the fitted rows together; its inverse, a component, is the usual width of a kernel."""
    a = model.loadings.shape[1]
    return float(model.eigenvalues[:a].sum() * (model.n - 1) / model.n / a)


def svm(df: DataFrame, label: str, components: int, c: float = 1.0, kind: str = "rbf", gamma: float | None = None, x: str = "x", tol: float = 1e-3) -> DataFrame:
    """sample_idx, observed, predicted: one machine a pair of classes on component scores, hinge loss, majority vote; ties go to the first class."""
    rows = df.where(F.col(label).isNotNull())
    classes = classes_of(rows, label)
    model, mean = fit_pca(rows, components, x)
    scored = rows.select("sample_idx", F.lit(0).alias("machine"), block(lambda r: (r - mean) @ model.loadings, x).alias("t"), F.lit(True).alias("learns"), F.col(label).alias("label"))
    widths = {0: gamma or 1 / (components * score_variance(model))}
    solved, _ = dual.svm_solved(scored, "label", classes, kind, widths, c, tol)
    return dual.svm_votes(solved, scored, "label", classes, kind, widths).select("sample_idx", "observed", "predicted")


def logistic(df: DataFrame, label: str, components: int, c: float = 1.0, x: str = "x") -> DataFrame:
    """Penalised logistic regression on component scores by pyspark.ml, intercepts free."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    classes = classes_of(df, label)
    scored = with_scores(df, *fit_pca(df, components, x), x)
    coded = scored.select("sample_idx", F.col(label).alias("observed"), array_to_vector("t").alias("features"), (F.array_position(F.lit(classes), F.col(label)) - 1).cast("double").alias("label"))
    model = LogisticRegression(regParam=1 / (c * coded.count()), elasticNetParam=0.0, standardization=False, family="binomial" if len(classes) == 2 else "multinomial", tol=1e-9, maxIter=500).fit(coded)
    return model.transform(coded).select("sample_idx", "observed", F.get(F.lit(classes), F.col("prediction").cast("int")).alias("predicted"))
