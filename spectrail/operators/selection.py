"""Variable selection and resampling inference.  Searches run on the folds' R factors, whose size doesn't grow with the samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

from . import kernels
from .factors import Fitted, factor, fold_factors, training_sets, weighted_factors
from .order import numbered, shuffled_key


def interval_bounds(width: int, k: int) -> list[tuple[int, int]]:
    """k runs of variables, the first width % k one longer, as (start, end) with the end left out."""
    size, extra = divmod(width, k)
    edges = np.cumsum([0, *[size + (i < extra) for i in range(k)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


class FoldErrors:
    """Cross-validated errors of variable subsets, from the R factor of each fold alone.

    Held-out residuals need a fold's rows only through |R_fold (1, -x, y)'|, so a
    subset is judged without touching the data again.
    """

    def __init__(self, df: DataFrame, y: str, fold: str = "fold", x: str = "x"):
        got = fold_factors(df, [y], fold, x).collect()
        self.parts = {r.fold: factor(r, 1) for r in got}
        if len(self.parts) < 2:
            raise Refused("a search needs two folds or more")
        self.width, self.df, self.y, self.x = got[0].width, df, y, x
        self.training = {k: Fitted.of([v for j, v in self.parts.items() if j != k], 1) for k in self.parts}

    def rmsecv(self, columns: np.ndarray, components: int) -> np.ndarray:
        """Pooled error for each number of components."""
        columns = np.asarray(columns)
        sse, n = 0.0, sum(p[0] for p in self.parts.values())
        for k, m in self.training.items():
            a = min(components, len(columns))
            model = kernels.pls(m.x[:, columns], m.y[:, 0], a, m.n)
            b = np.stack([model.coefficients(i) for i in range(1, a + 1)], 1)
            constant = m.y_mean[0] - m.x_mean[columns] @ b
            r = self.parts[k][1]
            e = r[:, -1:] - r[:, 1 + columns] @ b - np.outer(r[:, 0], constant)
            sse = sse + (e * e).sum(0)
        return np.sqrt(sse / n)


@dataclass
class Interval:
    start: int
    end: int
    components: int
    rmsecv: float


def ipls(errors: FoldErrors, k: int, components: int) -> tuple[list[Interval], list[int], list[float]]:
    """Each interval's best error; then intervals joined one by one while the union's error falls: chosen intervals and errors."""
    bounds, found = interval_bounds(errors.width, k), []
    for lo, hi in bounds:
        curve = errors.rmsecv(np.arange(lo, hi), components)
        found.append(Interval(lo, hi, int(np.argmin(curve)) + 1, float(curve.min())))
    chosen, path = [], []
    while len(chosen) < k:
        tried = [(float(errors.rmsecv(np.concatenate([np.arange(*bounds[i]) for i in sorted([*chosen, j])]), components).min()), j) for j in range(k) if j not in chosen]
        best, j = min(tried)
        if path and best >= path[-1]:
            break
        chosen.append(j)
        path.append(best)
    return found, chosen, path


def cars(df: DataFrame, errors: FoldErrors, y: str, components: int, runs: int = 50, seed: int = 0, x: str = "x") -> tuple[list[int], float]:
    """Competitive adaptive reweighted sampling: the subset of least cross-validated error, the first of equals.

    Rows are sampled by leaving out a fifth of twenty groups of rows, so that each
    run's fit is again a sum of R factors; a row's group is a hash of seed and
    sample_idx, whatever period the samples have.
    """
    fine = {r.fold: factor(r, 1) for r in fold_factors(df.withColumn("_fine", F.pmod(shuffled_key(seed, "sample_idx"), F.lit(20)).cast("int")), [y], "_fine", x).collect()}
    rng, p = np.random.default_rng(seed), errors.width
    rate = np.log(p / 2) / (runs - 1)
    left, best = np.arange(p), (np.inf, [])
    for i in range(1, runs + 1):
        picked = rng.permutation(list(fine))[: max(2, int(0.8 * len(fine)))]
        m = Fitted.of([fine[k] for k in picked], 1)
        b = np.abs(kernels.pls(m.x[:, left], m.y[:, 0], min(components, len(left)), m.n).coefficients())
        keep = max(2, min(len(left), round(p * (p / 2) ** (1 / (runs - 1)) * np.exp(-rate * i))))
        order = np.argsort(-b, kind="stable")[:keep]
        weight = b[order] / b[order].sum()
        left = np.sort(left[np.unique(rng.choice(order, size=len(order), p=weight))])
        error = float(errors.rmsecv(left, components).min())
        if error < best[0]:
            best = error, left.tolist()
        if len(left) <= 2:
            break
    return best[1], best[0]


def by_threshold(values: np.ndarray, cut: float = 1.0) -> list[int]:
    """Positions of the values at or over a cut: importance in projection, or sizes of coefficients."""
    return np.flatnonzero(np.abs(values) >= cut).tolist()


def _permuted(df: DataFrame, y: str, repeats: int, seed: int) -> DataFrame:
    """The rows with columns _p0, _p1, ...: y in as many random orders.

    Rows are numbered once in order of a hash.  In repeat k, place i takes the
    value of place (a_k i + b_k) mod n within the order of another hash, a and b
    drawn for the repeat and a prime to n; each repeat's value comes by a join
    on the place, and the repeats of a row meet again by its sample_idx.
    """
    placed = numbered(df.withColumn("_key", shuffled_key(seed, "sample_idx")), "_key", "sample_idx", into="_at").drop("_key")
    other = numbered(df.select("sample_idx", y, shuffled_key(seed + 1, "sample_idx").alias("_key")), "_key", "sample_idx", into="_from").select("_from", F.col(y).alias("_value"))
    n = df.count()
    rng, steps = np.random.default_rng(seed), []
    while len(steps) < repeats:
        a = int(rng.integers(1, n)) if n > 1 else 1
        if np.gcd(a, n) == 1:
            steps.append((len(steps), a, int(rng.integers(0, n))))
    table = df.sparkSession.createDataFrame(steps, "_k int, _a bigint, _b bigint")  # a row for each repeat
    # Products are taken as decimals: a and i can each have 63 bits.
    source = F.pmod(F.col("_a").cast("decimal(19,0)") * F.col("_at") + F.col("_b"), F.lit(n)).cast("bigint")
    long = placed.select("sample_idx", "_at").crossJoin(F.broadcast(table)).select("sample_idx", "_k", source.alias("_from")).join(other, "_from")
    wide = long.groupBy("sample_idx").agg(*[F.max(F.when(F.col("_k") == k, F.col("_value"))).alias(f"_p{k}") for k in range(repeats)])
    return df.join(wide, "sample_idx")


#: From the folds' errors of a training set to the columns it selects.
Selector = Callable[[FoldErrors], np.ndarray]


def _whole(errors: FoldErrors, components: int) -> kernels.Latent:
    m = Fitted.of(list(errors.parts.values()), 1)
    return kernels.pls(m.x, m.y[:, 0], min(components, errors.width), m.n)


def vip_selector(components: int, cut: float = 1.0) -> Selector:
    """Variables whose importance in projection is the cut or more."""
    return lambda errors: np.array(by_threshold(_whole(errors, components).vip(), cut))


def coefficient_selector(components: int, cut: float) -> Selector:
    """Variables whose coefficient is the cut or more by size."""
    return lambda errors: np.array(by_threshold(_whole(errors, components).coefficients(), cut))


def ipls_selector(intervals: int, components: int) -> Selector:
    """The variables of the intervals that forward selection joins."""

    def select(errors: FoldErrors) -> np.ndarray:
        bounds = interval_bounds(errors.width, intervals)
        return np.concatenate([np.arange(*bounds[i]) for i in sorted(ipls(errors, intervals, components)[1])])

    return select


def cars_selector(components: int, runs: int = 50, seed: int = 0) -> Selector:
    """The variables that competitive adaptive reweighted sampling keeps."""
    return lambda errors: np.array(cars(errors.df, errors, errors.y, components, runs, seed, errors.x)[0])


def permutation_test(df: DataFrame, y: str, components: int, repeats: int = 100, seed: int = 0, fold: str = "fold", x: str = "x") -> tuple[float, list[float], float]:
    """Cross-validated error, errors with permuted responses, and (1 + as good) / (repeats + 1).

    All permuted responses are further columns of one pass: R factors of
    [1, X, y, y_1, ..., y_repeats].  Nothing of the samples' number comes to
    the driver but the sizes of ranges.
    """
    targets = [y, *[f"_p{k}" for k in range(repeats)]]
    joined = _permuted(df.select("sample_idx", F.col(fold).alias(fold), F.col(y).cast("double").alias(y), F.col(x).alias(x)), y, repeats, seed)
    got = {r.fold: factor(r, len(targets)) for r in fold_factors(joined, targets, fold, x).collect()}
    n = sum(v[0] for v in got.values())
    width = next(iter(got.values()))[1].shape[1] - len(targets) - 1
    sse = np.zeros(len(targets))
    for k, (_, r) in got.items():
        m = Fitted.of([v for j, v in got.items() if j != k], len(targets))
        for t in range(len(targets)):
            b = kernels.pls(m.x, m.y[:, t], components, m.n).coefficients()
            e = r[:, 1 + width + t] - r[:, 1 : 1 + width] @ b - r[:, 0] * (m.y_mean[t] - m.x_mean @ b)
            sse[t] += e @ e
    errors = np.sqrt(sse / n)
    return float(errors[0]), errors[1:].tolist(), (1 + int((errors[1:] <= errors[0]).sum())) / (repeats + 1)


def bootstrap_coefficients(df: DataFrame, y: str, components: int, repeats: int = 200, level: float = 0.95, seed: int = 0, x: str = "x") -> DataFrame:
    """var_idx, lo, hi: percentile intervals of the coefficients.

    Rows drawn with replacement are Poisson weights of each row and repeat,
    from a hash of both; a task scales its rows for each repeat, so that no row
    is copied, and each repeat's R factor is one group of a single pass.
    """
    cuts = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 9)]))

    def weights(ids: np.ndarray) -> np.ndarray:
        """Of each repeat a row of Poisson(1) numbers, one for each sample."""
        h = ids.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(repeats, dtype=np.uint64)[:, None] + np.uint64(seed * 1_000_003)) * np.uint64(0xD1342543DE82EF95)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return np.searchsorted(cuts, (h >> np.uint64(11)) / 2.0**53)

    out = []
    for r in weighted_factors(df, [y], weights, x).collect():
        m = Fitted.of([factor(r, 1)], 1)
        out.append(kernels.pls(m.x, m.y[:, 0], components, m.n).coefficients())
    lo, hi = np.quantile(np.stack(out), [(1 - level) / 2, (1 + level) / 2], axis=0)
    return df.sparkSession.createDataFrame(pd.DataFrame({"var_idx": np.arange(len(lo)), "lo": lo, "hi": hi}))


def nested(df: DataFrame, y: str, components: int, select, inner: int = 5, fold: str = "fold", x: str = "x") -> float:
    """Error of a selection that is made anew inside each training set: select(FoldErrors) gives columns."""
    sse, n = 0.0, 0
    for r in df.select(fold).distinct().collect():
        train = df.where(F.col(fold) != r[0]).withColumn("_inner", F.pmod(F.col("sample_idx"), F.lit(inner)).cast("int"))
        errors = FoldErrors(train, y, "_inner", x)
        columns = np.asarray(select(errors))
        whole, _ = training_sets(train, [y], "_inner", x)
        b = kernels.pls(whole.x[:, columns], whole.y[:, 0], min(components, len(columns)), whole.n).coefficients()
        held = fold_factors(df.where(F.col(fold) == r[0]), [y], fold, x).collect()
        for h in held:
            m = factor(h, 1)[1]
            e = m[:, -1] - m[:, 1 + columns] @ b - m[:, 0] * (whole.y_mean[0] - whole.x_mean[columns] @ b)
            sse, n = sse + float(e @ e), n + h.n
    return float(np.sqrt(sse / n))
