"""Support vector machines for tables of any size: kernels through landmark rows, fitted by sums over the rows.

A bounded sample of ``landmarks`` rows stands for the kernel (Nystroem): a row's
features are its kernel values with the landmarks, whitened, and the machine is
linear in them.  Losses are the squared hinge and the squared
epsilon-insensitive one, so that each Newton step is a regression on the rows
that lie on the wrong side: one pass adds up their cross products, and the
driver holds landmarks squared numbers a machine, whatever the table's size.
They are models of their own; ``classification.svm`` and ``regression.svr`` have
the plain losses and the whole kernel, and take more passes the more support
vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

from . import kernels
from .classification import classes_of
from .decomposition import fit_pca
from .factors import training_sets
from .order import shuffled_key


@dataclass
class Front:
    """From variables to features of one machine, a constant last."""

    mean: np.ndarray
    loadings: np.ndarray
    points: np.ndarray
    gamma: float
    kind: str

    def __post_init__(self):
        values, vectors = np.linalg.eigh(kernels.kernel(self.points, self.points, self.kind, self.gamma))
        keep = values > 1e-10 * values.max()
        self.white = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, x: np.ndarray) -> np.ndarray:
        f = kernels.kernel((x - self.mean) @ self.loadings, self.points, self.kind, self.gamma) @ self.white
        return np.column_stack([f, np.ones(len(x))])

    @property
    def size(self) -> int:
        return self.white.shape[1] + 1


def _sample(df: DataFrame, most: int, seed: int, x: str) -> np.ndarray:
    """At most ``most`` rows, the first by a hash of seed and sample_idx."""
    rows = df.select("sample_idx", F.col(x).alias("x"), shuffled_key(seed, "sample_idx").alias("_key")).orderBy("_key", "sample_idx").limit(most).collect()
    return np.array([r.x for r in rows], float)


#: Of a block of rows (x, y, fold) and a machine's number: which rows it learns from, and their targets.
Task = Callable[[pd.DataFrame, int], tuple[np.ndarray, np.ndarray]]
#: Of targets and fitted values: which rows count, and what the next step fits them to.
Side = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _fit(rows: DataFrame, fronts: list[Front], task: Task, side: Side, c: float, most_passes: int = 30) -> list[np.ndarray]:
    """Weights of each machine: Newton steps of |w|^2 / 2 + c / 2 * squared losses, the constant free."""
    weights = [np.zeros(f.size) for f in fronts]
    before = [w.copy() for w in weights]
    live = set(range(len(fronts)))
    worth = {k: np.inf for k in live}
    for _ in range(most_passes):
        now, wanted = [w.copy() for w in weights], sorted(live)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = {k: [np.zeros((fronts[k].size, fronts[k].size)), np.zeros(fronts[k].size), 0.0] for k in wanted}  # noqa: B023
            for pdf in batches:
                for lo in range(0, len(pdf), 4096):
                    part = pdf.iloc[lo : lo + 4096]
                    x = np.stack(part["x"].to_list()).astype(float)
                    for k, h in held.items():
                        at, target = task(part, k)
                        f = fronts[k].features(x[at])
                        wrong, to = side(target, f @ now[k])  # noqa: B023
                        h[0] += f[wrong].T @ f[wrong]
                        h[1] += f[wrong].T @ to[wrong]
                        h[2] += float(((to - f @ now[k])[wrong] ** 2).sum())  # noqa: B023
            yield pd.DataFrame([{"machine": k, "part": 0, "sums": np.concatenate([a.ravel(), b, [loss]]).tobytes()} for k, (a, b, loss) in held.items()])

        def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"machine": key[0], "sums": np.sum([np.frombuffer(s, "<f8") for s in pdf["sums"]], axis=0).tobytes()}])

        got = rows.mapInPandas(sums, "machine int, part int, sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
        got = got.groupBy("machine", "part").applyInPandas(added, "machine int, sums binary").groupBy("machine").applyInPandas(added, "machine int, sums binary")
        for r in got.collect():
            k, values = r.machine, np.frombuffer(r.sums, "<f8")
            n = fronts[k].size
            gram, right, loss = values[: n * n].reshape(n, n), values[n * n : -1], values[-1]
            here = float(weights[k][:-1] @ weights[k][:-1]) / 2 + c / 2 * loss
            if here > worth[k] * (1 - 1e-9):
                live.discard(k)  # the last step no longer helped
                weights[k] = before[k] if here > worth[k] else weights[k]
                continue
            worth[k], before[k] = here, weights[k]
            ridge = np.eye(n) / c
            ridge[-1, -1] = 1e-12 * max(np.trace(gram) / n, 1.0)
            weights[k] = np.linalg.solve(gram + ridge, right)
            if np.allclose(weights[k], now[k], rtol=1e-9, atol=1e-12):
                live.discard(k)
        if not live:
            return weights
    return weights


def _hinge(sign: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sign * f < 1, sign


def _insensitive(epsilon: float) -> Side:
    def side(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.abs(y - f) > epsilon, y - epsilon * np.sign(y - f)

    return side


def _gamma(points: np.ndarray, gamma: float | None) -> float:
    return gamma or 1 / (points.shape[1] * max(points.var(), np.finfo(float).tiny))


def svm(df: DataFrame, label: str, components: int, c: float = 1.0, kind: str = "rbf", gamma: float | None = None, landmarks: int = 128, seed: int = 0, x: str = "x") -> DataFrame:
    """sample_idx, observed, predicted: a machine for each pair of classes on component scores, majority vote, ties to the first class.

    All pairs learn in the same passes, each from its two classes' rows.
    """
    classes = classes_of(df, label)
    model, mean = fit_pca(df, components, x)
    points = (_sample(df, landmarks, seed, x) - mean) @ model.loadings
    front = Front(mean, model.loadings, points, _gamma(points, gamma), kind)
    pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
    place = {name: i for i, name in enumerate(classes)}

    def task(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        of = part["label"].map(place).to_numpy()
        at = np.flatnonzero((of == pairs[k][0]) | (of == pairs[k][1]))
        return at, np.where(of[at] == pairs[k][0], 1.0, -1.0)

    rows = df.where(F.col(label).isNotNull()).select("sample_idx", F.col(label).alias("label"), F.col(x).alias("x"))
    weights = np.stack(_fit(rows, [front] * len(pairs), task, _hinge, c), 1)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = front.features(np.stack(pdf["x"].to_list()).astype(float)) @ weights if len(pdf) else np.zeros((0, len(pairs)))
            votes = np.zeros((len(pdf), len(classes)))
            for k, (i, j) in enumerate(pairs):
                votes[np.arange(len(pdf)), np.where(d[:, k] > 0, i, j)] += 1
            yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "observed": pdf["label"], "predicted": [classes[i] for i in votes.argmax(1)]})

    kind_of = dict(df.dtypes)[label]
    return rows.mapInPandas(vote, f"sample_idx bigint, observed {kind_of}, predicted {kind_of}")


def svr(df: DataFrame, y: str, components: int, c: float = 1.0, epsilon: float = 0.1, kind: str = "rbf", gamma: float | None = None, landmarks: int = 128, seed: int = 0, fold: str = "fold", x: str = "x") -> DataFrame:
    """sample_idx, fold, y, p: epsilon-insensitive regression on component scores, front, landmarks and machine refitted without each fold."""
    _, folds = training_sets(df, [y], fold, x)
    if not folds:
        raise Refused("cross-validation needs two folds or more")
    numbers, fronts = sorted(folds), []
    for k in numbers:
        m = folds[k]
        loadings = kernels.pca(m.x, components, m.n, 0.0).loadings
        points = (_sample(df.where(F.col(fold) != k), landmarks, seed, x) - m.x_mean) @ loadings
        fronts.append(Front(m.x_mean, loadings, points, _gamma(points, gamma), kind))

    def task(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(part["fold"] != numbers[k])
        return at, part["y"].to_numpy(float)[at]

    rows = df.select("sample_idx", F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), F.col(x).alias("x"))
    weights = _fit(rows, fronts, task, _insensitive(epsilon), c)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.zeros(len(pdf))
            for k, number in enumerate(numbers):
                at = np.flatnonzero(pdf["fold"] == number)
                if len(at):
                    p[at] = fronts[k].features(np.stack(pdf["x"].iloc[at].to_list()).astype(float)) @ weights[k]
            yield pdf[["sample_idx", "fold", "y"]].assign(p=p)

    return rows.mapInPandas(predict, "sample_idx bigint, fold int, y double, p double")
