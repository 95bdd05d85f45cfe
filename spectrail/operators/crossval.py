"""Cross-validated classifiers: every fold's model comes from one pass of R factors, one for each fold and class.

The R factor of [1, X] over the rows of a (fold, class) cell is all that
discriminants, SIMCA and PLS-DA need of them.  Leaving a fold out stacks the
cells of the others, so all folds, centring and components included, are
refitted without another pass; a second pass scores each row with the model
that hasn't seen it.  Sizes on the driver depend on variables, classes and
folds only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused
from spectrail.functions.quantiles import spe_limit, t2_limit

from . import kernels, scorers
from .classification import classes_of
from .decomposition import Group
from .factors import Fitted, factor, fold_factors, stacked
from .neighbours import knn


@dataclass
class Model:
    """scores(X), a column for each class (or one, cut at 0.5), the largest (or least) of which counts; what it is made of, to be stored."""

    scores: Callable[[np.ndarray], np.ndarray]
    largest: bool = True
    kind: str = ""
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def picked(self, scores: np.ndarray) -> np.ndarray:
        if scores.shape[1] == 1:
            return (scores[:, 0] >= 0.5).astype(int)
        return np.argmax(scores if self.largest else -scores, axis=1)


#: From each class's training rows to a model.
Builder = Callable[[list[Group]], Model]


def training_groups(df: DataFrame, label: str, fold: str = "fold", x: str = "x") -> tuple[list, dict[int, list[Group]]]:
    """The classes, and for each fold every class's rows outside it; a fold that leaves a class or all but one without rows is refused."""
    classes = classes_of(df, label)
    cell = F.col(fold).cast("int") * len(classes) + F.array_position(F.lit(classes), F.col(label)).cast("int") - 1
    cells = {divmod(r.fold, len(classes)): factor(r, 0) for r in fold_factors(df.where(F.col(label).isNotNull()).withColumn("_cell", cell), [], "_cell", x).collect()}
    folds = sorted({k for k, _ in cells})
    if len(folds) < 2:
        raise Refused("cross-validation needs two folds or more")
    out = {}
    for k in folds:
        groups = []
        for c, name in enumerate(classes):
            parts = [cells[j, c] for j in folds if j != k and (j, c) in cells]
            if not parts:
                raise Refused(f"fold {k} trains without class {name}")
            groups.append(Group(sum(n for n, _ in parts), stacked([r for _, r in parts])))
        out[k] = groups
    return classes, out


def pooled(groups: list[Group]) -> Group:
    return Group(sum(g.n for g in groups), stacked([g.r for g in groups]))


def coded(groups: list[Group]) -> Fitted:
    """Moments of X and the class code: 0 and 1 for two classes, a column for each of more."""
    wanted = [1] if len(groups) == 2 else list(range(len(groups)))
    rows = [np.column_stack([g.r, *[g.r[:, 0] * (c == k) for k in wanted]]) for c, g in enumerate(groups)]
    return Fitted.of([(g.n, r) for g, r in zip(groups, rows, strict=True)], len(wanted))


def _linear(m: Fitted, b: np.ndarray) -> Model:
    arrays = {"b": b.reshape(len(m.x_mean), -1), "x_mean": m.x_mean, "y_mean": m.y_mean}
    return Model(scorers.linear(arrays), True, "classes", arrays)


def pls_da(components: int) -> Builder:
    def build(groups: list[Group]) -> Model:
        m = coded(groups)
        return _linear(m, kernels.pls(m.x, m.y[:, 0] if m.y.shape[1] == 1 else m.y, components, m.n).coefficients())

    return build


def opls_da(orthogonal: int) -> Builder:
    """Two classes only."""

    def build(groups: list[Group]) -> Model:
        if len(groups) != 2:
            raise Refused(f"OPLS-DA tells two classes apart, not {len(groups)}")
        m = coded(groups)
        return _linear(m, kernels.opls(m.x, m.y[:, 0], orthogonal, m.n)[0])

    return build


def discriminant(components: int, quadratic: bool = False, reg: float = 0.0) -> Builder:
    """Linear or quadratic, on component scores refitted with the fold; priors as found."""

    def build(groups: list[Group]) -> Model:
        whole = pooled(groups)
        p = kernels.pca(whole.centred, components, whole.n).loadings
        means = [(g.mean - whole.mean) @ p for g in groups]
        scatters = [(t := g.centred @ p).T @ t for g in groups]
        prior = [np.log(g.n / whole.n) for g in groups]
        if not quadratic and whole.n - len(groups) < components:
            raise Refused(f"{whole.n} samples of {len(groups)} classes leave too few degrees of freedom")
        shared = None if quadratic else np.linalg.pinv(sum(scatters) / (whole.n - len(groups)))
        forms = []
        for k, g in enumerate(groups):
            if not quadratic:
                forms.append((shared, prior[k]))
                continue
            values, vectors = np.linalg.eigh(scatters[k] / max(g.n - 1, 1))
            values = (1 - reg) * values + reg
            if g.n <= 1 or values.min() <= 1e-12 * values.max():
                raise Refused(f"the covariance of class number {k} is singular")
            forms.append((vectors / values @ vectors.T, prior[k] - 0.5 * np.log(values).sum()))

        inverses, constants = (np.stack(v) for v in zip(*forms, strict=True))
        arrays = {"x_mean": whole.mean, "loadings": p, "centres": np.stack(means), "inverses": inverses, "constants": constants}
        return Model(scorers.discriminant(arrays), True, "discriminant", arrays)

    return build


def simca(components: int, alpha: float = 0.05) -> Builder:
    """Scores are the distances h to each class's component model, in units of its limits; h <= 1 is accepted."""

    def build(groups: list[Group]) -> Model:
        parts = []
        for g in groups:
            model = kernels.pca(g.centred, components, g.n)
            spe = spe_limit(model.eigenvalues, components, alpha) if components < len(model.eigenvalues) else 0.0
            parts.append((g.mean, model.loadings, model.eigenvalues[:components], np.array([t2_limit(g.n, components, alpha, True), spe])))
        arrays = dict(zip(("means", "loadings", "eigenvalues", "limits"), (np.stack(v) for v in zip(*parts, strict=True)), strict=True))
        return Model(scorers.simca(arrays), False, "simca", arrays)

    return build


def cross_validated(df: DataFrame, label: str, build: Builder, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, fold, observed, predicted, scores (one for each class in order, or one): each row by the model without its fold.

    Rows with a null label are neither learned from nor scored; ties go to the first class.
    """
    classes, folds = training_groups(df, label, fold, x)
    models = {k: build(groups) for k, groups in folds.items()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores, pick = np.empty(len(pdf), object), np.zeros(len(pdf), int)
            for k in pdf["fold"].unique():
                at = np.flatnonzero(pdf["fold"] == k)
                s = models[k].scores(np.stack(pdf["x"].iloc[at].to_list()).astype(float))
                pick[at] = models[k].picked(s)
                for i, v in zip(at, s, strict=True):
                    scores[i] = v
            yield pdf[["sample_idx", "fold", "observed"]].assign(predicted=[classes[i] for i in pick], scores=pd.Series(scores, index=pdf.index))

    kind = dict(df.dtypes)[label]
    rows = df.where(F.col(label).isNotNull()).select("sample_idx", F.col(fold).cast("int").alias("fold"), F.col(label).alias("observed"), F.col(x).alias("x"))
    return rows.mapInPandas(score, f"sample_idx bigint, fold int, observed {kind}, predicted {kind}, scores array<double>")


def accepted(df: DataFrame, label: str, components: int, alpha: float = 0.05, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, observed, model, h, accepted: held-out rows against every class's model; several or none may accept."""
    names = F.lit(classes_of(df, label))
    long = cross_validated(df, label, simca(components, alpha), fold, x).select("sample_idx", "observed", F.posexplode("scores").alias("pos", "h"))
    return long.select("sample_idx", "observed", F.get(names, F.col("pos")).alias("model"), "h", (F.col("h") <= 1).alias("accepted"))


def knn_cross_validated(df: DataFrame, label: str, components: int, k: int, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, fold, observed, predicted: votes of the k nearest rows of the other folds on component scores refitted without the fold."""
    _, folds = training_groups(df, label, fold, x)
    out = None
    for number, groups in folds.items():
        whole = pooled(groups)
        p = kernels.pca(whole.centred, components, whole.n).loadings
        rows = _projected(df, whole.mean, p, x)
        part = knn(rows.where(F.col(fold) != number), rows.where(F.col(fold) == number), label, k, "_t").withColumn("fold", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out.select("sample_idx", "fold", "observed", "predicted")


def _projected(df: DataFrame, mean: np.ndarray, p: np.ndarray, x: str) -> DataFrame:
    from spectrail.functions.arrays import block

    return df.withColumn("_t", block(lambda rows: (rows - mean) @ p, x))


def logistic_cross_validated(df: DataFrame, label: str, components: int, c: float = 1.0, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, fold, observed, predicted: penalised logistic regression (pyspark.ml) on component scores, refitted without each fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    classes, folds = training_groups(df, label, fold, x)
    out = None
    for number, groups in folds.items():
        whole = pooled(groups)
        p = kernels.pca(whole.centred, components, whole.n).loadings
        rows = _projected(df, whole.mean, p, x).select("sample_idx", F.col(fold).cast("int").alias("fold"), F.col(label).alias("observed"), array_to_vector("_t").alias("features"), (F.array_position(F.lit(classes), F.col(label)) - 1).cast("double").alias("label"))
        fitted = LogisticRegression(regParam=1 / (c * whole.n), standardization=False, family="binomial" if len(classes) == 2 else "multinomial", tol=1e-9, maxIter=500).fit(rows.where(F.col("fold") != number))
        part = fitted.transform(rows.where(F.col("fold") == number)).select("sample_idx", "fold", "observed", F.get(F.lit(classes), F.col("prediction").cast("int")).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def simca_class_metrics(decided: DataFrame) -> DataFrame:
    """class (null: pooled), n, sensitivity (own rows accepted), specificity (others' rows refused) of rows with observed, model, accepted."""
    own, yes = F.col("observed") == F.col("model"), F.col("accepted").cast("double")
    sums = decided.groupBy(F.col("model").alias("class")).agg(F.count(F.when(own, 1)).alias("n"), F.sum(F.when(own, yes)).alias("hit"), F.count(F.when(~own, 1)).alias("others"), F.sum(F.when(~own, 1 - yes)).alias("kept_out"))
    whole = sums.agg(*[F.sum(c).alias(c) for c in ("n", "hit", "others", "kept_out")]).select(F.lit(None).cast(dict(sums.dtypes)["class"]).alias("class"), "n", "hit", "others", "kept_out")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.unionByName(whole).select("class", "n", ratio("hit", "n").alias("sensitivity"), ratio("kept_out", "others").alias("specificity"))


def dummy_rmse(predicted: DataFrame, label: str, classes: list) -> DataFrame:
    """rmse over all rows and columns of the class code: scores less 1 for the own class and 0 for others (one column for two classes)."""
    wanted = classes[1:] if len(classes) == 2 else classes
    long = predicted.select(F.col(label).alias("observed"), F.posexplode("scores").alias("pos", "p"))
    own = (F.get(F.lit(wanted), F.col("pos")) == F.col("observed")).cast("double")
    return long.agg(F.sqrt(F.avg((F.col("p") - own) ** 2)).alias("rmse"))
