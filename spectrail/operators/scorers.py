"""From a fitted model's arrays to a function of rows: what cross-validation, stored models and streams score with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import kernels

Arrays = dict[str, np.ndarray]
Scorer = Callable[[np.ndarray], np.ndarray]


def linear(a: Arrays) -> Scorer:
    b = a["b"].reshape(len(a["x_mean"]), -1)
    return lambda x: (x - a["x_mean"]) @ b + np.atleast_1d(a["y_mean"])


def components(a: Arrays) -> Scorer:
    """Scores, then t2 and spe."""
    spread = a["eigenvalues"][: a["loadings"].shape[1]]

    def run(x: np.ndarray) -> np.ndarray:
        c = x - a["x_mean"]
        t = c @ a["loadings"]
        return np.column_stack([t, (t**2 / spread).sum(1), np.maximum((c * c).sum(1) - (t * t).sum(1), 0)])

    return run


def simca(a: Arrays) -> Scorer:
    """The distance h to each class's components, in units of its limits; a class without a limit of residuals goes by t2."""

    def run(x: np.ndarray) -> np.ndarray:
        out = []
        for mean, p, values, (t2_top, spe_top) in zip(a["means"], a["loadings"], a["eigenvalues"], a["limits"], strict=True):
            c = x - mean
            t = c @ p
            h = (t**2 / values).sum(1) / t2_top
            out.append(np.maximum(h, np.maximum((c * c).sum(1) - (t * t).sum(1), 0) / spe_top) if spe_top else h)
        return np.stack(out, 1)

    return run


def discriminant(a: Arrays) -> Scorer:
    """Linear or quadratic forms of component scores, with their constants."""

    def run(x: np.ndarray) -> np.ndarray:
        t = (x - a["x_mean"]) @ a["loadings"]
        return np.stack([k - 0.5 * (((t - m) @ inverse) * (t - m)).sum(1) for m, inverse, k in zip(a["centres"], a["inverses"], a["constants"], strict=True)], 1)

    return run


def logistic(a: Arrays) -> Scorer:
    """A chance for two classes, else a value a class."""

    def run(x: np.ndarray) -> np.ndarray:
        z = (x - a["x_mean"]) @ a["loadings"] @ a["weights"].T + a["constants"]
        return 1 / (1 + np.exp(-z)) if z.shape[1] == 1 else z

    return run


def neighbours(a: Arrays) -> Scorer:
    """Shares of the k nearest stored rows by class; of equal distances (to 12 places) the row stored first."""
    k, classes = int(a["k"].ravel()[0]), int(a["n_classes"].ravel()[0])
    of = a["of"].astype(int)

    def run(x: np.ndarray) -> np.ndarray:
        t, out = (x - a["x_mean"]) @ a["loadings"], np.zeros((len(x), classes))
        for lo in range(0, len(t), 256):
            d = np.maximum((t[lo : lo + 256] ** 2).sum(1)[:, None] + (a["points"] ** 2).sum(1)[None] - 2 * t[lo : lo + 256] @ a["points"].T, 0)
            near = of[np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]]
            for c in range(classes):
                out[lo : lo + 256, c] = (near == c).mean(1)
        return out

    return run


def _values(a: Arrays, x: np.ndarray) -> np.ndarray:
    """The value of each machine (a row of beta) at each row."""
    t, kind = (x - a["x_mean"]) @ a["loadings"], "linear" if a["linear"].ravel()[0] else "rbf"
    return kernels.kernel(t, a["points"], kind, float(a["gamma"].ravel()[0])) @ a["beta"].T + a["constants"]


def machines(a: Arrays) -> Scorer:
    """Votes of one machine a pair of classes; a value above zero is one for the pair's first."""
    pairs, classes = a["pairs"].astype(int), int(a["n_classes"].ravel()[0])

    def run(x: np.ndarray) -> np.ndarray:
        d, votes = _values(a, x), np.zeros((len(x), classes))
        for k, (i, j) in enumerate(pairs):
            votes[np.arange(len(x)), np.where(d[:, k] > 0, i, j)] += 1
        return votes

    return run


def kernel_regression(a: Arrays) -> Scorer:
    return lambda x: _values(a, x)
