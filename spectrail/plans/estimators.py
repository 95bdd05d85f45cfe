"""What an estimator node computes from its input's matrix: a final model of all samples, and below a split each fold's on what it holds out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused, block, list_of, matrix_of
from spectrail.functions.quantiles import spe_caveat, t2_limit
from spectrail.operators import classification, crossval, dual, kernels, metrics, neighbours, regression, scorers
from spectrail.operators.decomposition import Group, limits

from .models import Model
from .store import ALL

__all__ = ["Group", "RUNNERS", "Found", "options_of"]


@dataclass
class Found:
    """Per-sample rows with ``part`` (calibration or cross_validation) and ``fold``; the numbers of these rows once they are stored; what can be applied later."""

    rows: DataFrame
    numbers: Callable[[DataFrame], list[list]]
    model: Model | None = None


#: Most stored rows (neighbours) or support vectors of a model that can be applied later; with more, a node has its results and no such model.
MOST_POINTS = 100_000

#: Options of each estimator; those without a default must be given.
OPTIONS = {
    "pca": {"n_components": None, "alpha": 0.05},
    "pls": {"target": None, "n_components": None},
    "pcr": {"target": None, "n_components": None},
    "ridge": {"target": None, "alpha": 1.0},
    "elastic_net": {"target": None, "alpha": 1.0, "l1_ratio": 0.5},
    "mlr": {"target": None},
    "opls": {"target": None, "n_orthogonal": 1},
    "svr": {"target": None, "n_components": None, "kernel": "rbf", "C": 1.0, "epsilon": 0.1, "gamma": 0.0},
    "plsda": {"class_column": None, "n_components": None},
    "oplsda": {"class_column": None, "n_orthogonal": 1},
    "lda": {"class_column": None, "n_components": None},
    "qda": {"class_column": None, "n_components": None, "reg_param": 0.0},
    "simca": {"class_column": None, "n_components": None, "alpha": 0.05},
    "knn": {"class_column": None, "n_components": None, "k": None},
    "logistic": {"class_column": None, "n_components": None, "C": 1.0},
    "svm": {"class_column": None, "n_components": None, "kernel": "rbf", "C": 1.0, "gamma": 0.0},
}


def options_of(kind: str, given: dict) -> dict:
    """An estimator's options with their defaults; unknown and missing ones are refused."""
    known = OPTIONS[kind]
    if unknown := given.keys() - known.keys():
        raise Refused(f"{kind} has no option {', '.join(sorted(unknown))}")
    out = known | given
    if missing := [k for k, v in out.items() if v is None]:
        raise Refused(f"{kind} needs {', '.join(missing)}")
    return out


def _scored(rows: DataFrame, models: dict[int, Callable[[np.ndarray], np.ndarray]], keep: dict[str, str]) -> DataFrame:
    """``sample_idx, fold, <keep>, scores`` of rows with ``fold``: each block of rows by its fold's function."""
    names = list(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            of, x, out = batch.column("fold").to_numpy(), matrix_of(batch.column("x")), None
            for k in np.unique(of).tolist():
                at = np.flatnonzero(of == k)
                s = models[k](x[at])
                out = np.empty((len(x), s.shape[1])) if out is None else out
                out[at] = s
            kept = ["sample_idx", "fold", *names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), list_of(out)], [*kept, "scores"])

    schema = ", ".join(["sample_idx bigint", "fold int", *(f"`{c}` {t}" for c, t in keep.items()), "scores array<double>"])
    return rows.select("sample_idx", F.col("fold").cast("int").alias("fold"), *names, "x").mapInArrow(score, schema)


def _both(m, models: dict, keep: dict[str, str]) -> DataFrame:
    """Rows scored by the final model, and below a split held-out rows by their fold's, with ``part``."""
    out = _scored(m.everything().drop("fold").withColumn("fold", F.lit(ALL)), models, keep).withColumn("part", F.lit("calibration"))
    return out if m.folds is None else out.unionByName(_scored(m.held_out(), models, keep).withColumn("part", F.lit("cross_validation")))


def _with(m, **columns):
    """The matrix with columns of these names, rows without a value for one left out."""
    if m.above is not None:
        return m.over(_with(m.above, **columns))
    df = m.df.withColumns(columns)
    return type(m)(reduce(lambda d, c: d.where(F.col(c).isNotNull()), columns, df), m.folds, m.versioned)


def _named(part: str, row, names: list[str]) -> list[list]:
    return [[part, n, None if row is None or row[n] is None else float(row[n])] for n in names]


def _target(m, name: str, cast: str | None = None):
    if name not in m.df.columns or name in ("x", "fold", "held", "sample_idx"):
        raise Refused(f"{name} isn't a column of the source")
    return F.col(name).cast(cast) if cast else F.col(name)


def _pca(m, o: dict) -> Found:
    a = o["n_components"]
    fits = {k: (f, kernels.pca(f.x, a, f.n)) for k, f in _with(m, _y=F.lit(0.0)).factors(["_y"]).items()}

    distances = lambda f, p: scorers.components({"loadings": p.loadings, "eigenvalues": p.eigenvalues, "x_mean": f.x_mean})
    whole, model = fits[ALL]
    top = limits(model, o["alpha"])
    new = t2_limit(model.n, a, o["alpha"], True)
    rows = _both(m, {k: distances(*v) for k, v in fits.items()}, {})
    rows = rows.select("sample_idx", "part", "fold", F.slice("scores", 1, a).alias("t"), F.get("scores", F.lit(a)).alias("t2"), F.get("scores", F.lit(a + 1)).alias("spe"))
    over = (F.col("t2") > F.when(F.col("part") == "calibration", float(top["t2"])).otherwise(float(new))) | (F.lit(top["spe"] > 0) & (F.col("spe") > float(top["spe"])))

    def numbers(stored: DataFrame) -> list[list]:
        out = [["calibration", "t2_limit", float(top["t2"])], ["calibration", "spe_limit", float(top["spe"])]]
        out += [["calibration", f"explained_{k + 1}", float(v)] for k, v in enumerate(model.explained)]
        out += [["calibration", f"total_{k + 1}", float(v)] for k, v in enumerate(np.cumsum(model.explained))]
        if spe_caveat(model.eigenvalues, a) is not None:
            out.append(["calibration", "spe_limit_is_rough", 1.0])
        for r in stored.groupBy("part").agg(F.avg(F.col("flagged").cast("double")).alias("flagged"), F.avg("spe").alias("spe_mean")).orderBy("part").collect():
            out += _named(r["part"], r, ["flagged", "spe_mean"])
        return out

    found = Model("components", {"loadings": model.loadings, "eigenvalues": model.eigenvalues, "x_mean": whole.x_mean, "limits": np.array([top["t2"], top["spe"]])})
    return Found(rows.withColumn("flagged", over), numbers, found)


def _regression_numbers(free: int) -> Callable[[DataFrame], list[list]]:
    def numbers(stored: DataFrame) -> list[list]:
        inside = metrics.regression_metrics(stored.where("part = 'calibration'"), n_components=free).withColumnRenamed("rmse", "rmsec").first()
        out = _named("calibration", inside, ["n", "rmsec", "bias", "r2", "sec", "r2_pearson"])
        held = metrics.cross_validation(stored.where("part = 'cross_validation'")).collect()
        pooled = next((r for r in held if r["fold"] is None), None)
        if pooled is not None and pooled["n"]:
            out += _named("cross_validation", pooled, ["n", "rmsecv", "q2", "rmsecv_std"])
            out += [["cross_validation", f"rmsecv_fold_{r['fold']}", float(r["rmsecv"])] for r in sorted((r for r in held if r["fold"] is not None), key=lambda r: r["fold"])]
        return out

    return numbers


def _linear(fit_of: Callable[[dict], regression.Fit], free: Callable[[dict], int]):
    def run(m, o: dict) -> Found:
        m = _with(m, _y=_target(m, o["target"], "double"))
        fit = fit_of(o)
        fits = {k: (f, fit(f)[-1]) for k, f in m.factors(["_y"]).items()}
        line = lambda f, b: lambda x: ((x - f.x_mean) @ b + f.y_mean[0])[:, None]
        rows = _both(m, {k: line(*v) for k, v in fits.items()}, {"_y": "double"}).select("sample_idx", "part", "fold", F.col("_y").alias("y"), F.get("scores", F.lit(0)).alias("p"))
        whole, b = fits[ALL]
        numbers = _regression_numbers(free(o) if free(o) >= 0 else len(b))
        fitted = [["coefficients", str(j), float(v)] for j, v in enumerate(b)] + [["coefficients", "intercept", float(whole.y_mean[0] - whole.x_mean @ b)]]
        return Found(rows, lambda stored: numbers(stored) + fitted, Model("regression", {"b": b, "x_mean": whole.x_mean, "y_mean": whole.y_mean}))

    return run


def _class_numbers(stored: DataFrame) -> list[list]:
    out = []
    for part in ("calibration", "cross_validation"):
        rows = stored.where(F.col("part") == part)
        whole = metrics.accuracy(rows).first()
        if whole["n"]:
            out += _named(part, whole, ["n", "accuracy"])
            if part == "cross_validation":
                for r in metrics.class_metrics(rows).orderBy("class").collect():
                    out += _named(f"class {r['class']}", r, ["n", "sensitivity", "specificity", "precision"])
    return out


def _class_rows(m, models: dict[int, crossval.Model], label: str, classes: list) -> DataFrame:
    def scored(model: crossval.Model) -> Callable[[np.ndarray], np.ndarray]:
        def run(x: np.ndarray) -> np.ndarray:
            s = model.scores(x)
            return np.column_stack([s, model.picked(s)])

        return run

    rows = _both(m, {k: scored(v) for k, v in models.items()}, {label: dict(m.df.dtypes)[label]})
    last = F.size("scores") - 1
    return rows.select("sample_idx", "part", "fold", F.col(label).alias("observed"), F.get(F.lit(classes), F.get("scores", last).cast("int")).alias("predicted"), F.slice("scores", F.lit(1), last).alias("scores"))


def _classes(builder: Callable[[dict], crossval.Builder]):
    def run(m, o: dict) -> Found:
        m = _with(m, _label=_target(m, o["class_column"]))
        classes = classification.classes_of(m.everything(), "_label")
        groups = m.groups("_label", classes)
        build = builder(o)
        models = {k: build(g) for k, g in groups.items()}
        return Found(_class_rows(m, models, "_label", classes), _class_numbers, Model(models[ALL].kind, models[ALL].arrays, classes=classes))

    return run


def _fronts(m, components: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each version: means, loadings, and the variance of all score values together."""
    out = {}
    for k, f in _with(m, _y=F.lit(0.0)).factors(["_y"]).items():
        p = kernels.pca(f.x, components, f.n)
        out[k] = f.x_mean, p.loadings, float(p.eigenvalues[:components].sum() * (f.n - 1) / f.n / components)
    return out


def _projected(df: DataFrame, front: tuple) -> DataFrame:
    mean, loadings, _ = front
    return df.withColumn("_t", block(lambda rows: (rows - mean) @ loadings, "x"))


def _parts(m, one: Callable[[int, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """one(version, training rows, rows to predict) for all samples and each fold, end to end."""
    out = [one(k, *m.pair(k)).withColumn("fold", F.lit(k)).withColumn("part", F.lit("calibration" if k == ALL else "cross_validation")) for k in m.versions]
    return reduce(DataFrame.unionByName, out)


def _knn(m, o: dict) -> Found:
    m = _with(m, _label=_target(m, o["class_column"]))
    fronts = _fronts(m, o["n_components"])
    one = lambda k, train, queries: neighbours.knn(_projected(train, fronts[k]), _projected(queries, fronts[k]), "_label", o["k"], "_t")
    mean, loadings, _ = fronts[ALL]
    stored, model = _projected(m.everything(), fronts[ALL]).select("sample_idx", "_t", "_label").limit(MOST_POINTS + 1).collect(), None
    if len(stored) <= MOST_POINTS:
        classes = classification.classes_of(m.everything(), "_label")
        stored.sort(key=lambda r: r["sample_idx"])
        points, of = np.array([r["_t"] for r in stored]), np.array([classes.index(r["_label"]) for r in stored], float)
        model = Model("neighbours", {"x_mean": mean, "loadings": loadings, "points": points, "of": of, "k": np.array([o["k"]]), "n_classes": np.array([len(classes)])}, classes=classes)
    return Found(_parts(m, one).select("sample_idx", "part", "fold", "observed", "predicted"), _class_numbers, model)


def _logistic(m, o: dict) -> Found:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    m = _with(m, _label=_target(m, o["class_column"]))
    classes, fronts, models = classification.classes_of(m.everything(), "_label"), _fronts(m, o["n_components"]), {}
    for k in m.versions:
        rows = _projected(m.pair(k)[0], fronts[k]).select(array_to_vector("_t").alias("features"), (F.array_position(F.lit(classes), F.col("_label")) - 1).cast("double").alias("label"))
        fit = LogisticRegression(regParam=1 / (o["C"] * rows.count()), standardization=False, family="binomial" if len(classes) == 2 else "multinomial", tol=1e-9, maxIter=500).fit(rows)
        arrays = {"x_mean": fronts[k][0], "loadings": fronts[k][1], "weights": fit.coefficientMatrix.toArray(), "constants": fit.interceptVector.toArray()}
        models[k] = crossval.Model(scorers.logistic(arrays), True, "logistic", arrays)
    return Found(_class_rows(m, models, "_label", classes), _class_numbers, Model("logistic", models[ALL].arrays, classes=classes))


def _gamma(o: dict, front: tuple) -> float:
    return o["gamma"] or 1 / (o["n_components"] * front[2])


def _svr(m, o: dict) -> Found:
    m = _with(m, _y=_target(m, o["target"], "double"))
    fronts = _fronts(m, o["n_components"])
    rows = dual.svr_rows(_machines(m, fronts, ["_y"]), "_y", o["C"], o["epsilon"])
    solved = dual.solve(rows, o["kernel"], {k: _gamma(o, f) for k, f in fronts.items()})
    found = solved.decided().where("learns = (machine = -1) and asked").select("sample_idx", F.col("machine").alias("fold"), "y", F.col("decision").alias("p"))
    model = _machine_model("kernel_regression", o, fronts[ALL], solved, F.col("machine") == ALL, [ALL])
    return Found(found.withColumn("part", F.when(F.col("fold") == ALL, "calibration").otherwise("cross_validation")), _regression_numbers(o["n_components"]), model)


def _machine_model(kind: str, o: dict, front: tuple, solved: dual.Solved, where, machines: list[int], **more) -> Model | None:
    """The support vectors of some machines, each row once with a weight a machine; None if they are more than MOST_POINTS."""
    got = solved.support(where, MOST_POINTS)
    if got is None:
        return None
    place: dict[tuple, int] = {}
    for r in got:
        place.setdefault(tuple(r["t"]), len(place))
    beta = np.zeros((len(machines), len(place)))
    for r in got:
        beta[machines.index(r["machine"]), place[tuple(r["t"])]] += r["beta"]
    arrays = {"x_mean": front[0], "loadings": front[1], "points": np.array(list(place)).reshape(len(place), -1), "beta": beta, "constants": np.array([solved.constant.get(k, 0.0) for k in machines]), "gamma": np.array([_gamma(o, front)]), "linear": np.array([float(o["kernel"] == "linear")])}
    classes = more.pop("classes", [])
    return Model(kind, arrays | more, classes=classes)


def _machines(m, fronts: dict[int, tuple], keep: list[str]) -> DataFrame:
    """``sample_idx, machine, t, learns, <keep>``: each version's training rows, which learn, and its held-out rows, which don't."""
    out = []
    for k in m.versions:
        train, queries = m.pair(k)
        rows = _projected(train, fronts[k]).withColumn("learns", F.lit(True))
        if k != ALL:
            rows = rows.unionByName(_projected(queries, fronts[k]).withColumn("learns", F.lit(False)))
        out.append(rows.select("sample_idx", F.lit(k).alias("machine"), F.col("_t").alias("t"), "learns", *keep))
    return reduce(DataFrame.unionByName, out)


def _svm(m, o: dict) -> Found:
    m = _with(m, _label=_target(m, o["class_column"]))
    classes, fronts = classification.classes_of(m.everything(), "_label"), _fronts(m, o["n_components"])
    rows, widths = _machines(m, fronts, ["_label"]), {k: _gamma(o, f) for k, f in fronts.items()}
    solved, pairs = dual.svm_solved(rows, "_label", classes, o["kernel"], widths, o["C"])
    found = dual.svm_votes(solved, rows, "_label", classes, o["kernel"], widths).where("learns = (machine = -1)").select("sample_idx", F.col("machine").alias("fold"), "observed", "predicted")
    first = sorted(fronts).index(ALL) * len(pairs)
    model = _machine_model("machines", o, fronts[ALL], solved, F.col("owner") == ALL, list(range(first, first + len(pairs))), classes=classes, pairs=np.array(pairs, float), n_classes=np.array([len(classes)]))
    return Found(found.withColumn("part", F.when(F.col("fold") == ALL, "calibration").otherwise("cross_validation")), _class_numbers, model)


#: What runs each kind of estimator.
_KINDS = {
    "pca": _pca,
    "pls": _linear(lambda o: regression.pls_path(o["n_components"]), lambda o: o["n_components"]),
    "pcr": _linear(lambda o: regression.pcr_path(o["n_components"]), lambda o: o["n_components"]),
    "ridge": _linear(lambda o: regression.ridge_path([o["alpha"]]), lambda o: 0),
    "elastic_net": _linear(lambda o: regression.elastic_net_path([o["alpha"]], o["l1_ratio"]), lambda o: 0),
    "mlr": _linear(lambda o: regression.mlr_fit, lambda o: -1),
    "opls": _linear(lambda o: regression.opls_path(o["n_orthogonal"]), lambda o: 1 + o["n_orthogonal"]),
    "svr": _svr,
    "plsda": _classes(lambda o: crossval.pls_da(o["n_components"])),
    "oplsda": _classes(lambda o: crossval.opls_da(o["n_orthogonal"])),
    "lda": _classes(lambda o: crossval.discriminant(o["n_components"])),
    "qda": _classes(lambda o: crossval.discriminant(o["n_components"], True, o["reg_param"])),
    "simca": _classes(lambda o: crossval.simca(o["n_components"], o["alpha"])),
    "knn": _knn,
    "logistic": _logistic,
    "svm": _svm,
}
RUNNERS = {kind: (lambda m, o, kind=kind, run=run: run(m, options_of(kind, o))) for kind, run in _KINDS.items()}
