"""Outlier diagnostics as columns and flag tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions import quantiles
from spectrail.functions.arrays import Refused

from . import kernels
from .order import numbered, shuffled_key  # noqa: F401  (numbered is part of this module's interface)


def with_leverage(df: DataFrame, components: int, t: str = "t") -> DataFrame:
    """Leverage of [1, t]; its moments are the only thing on the driver."""
    names = [F.lit(1.0), *[F.get(t, F.lit(a)) for a in range(components)]]
    size = len(names)
    sums = df.agg(*[F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    gram = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
    inverse = np.linalg.inv(gram)
    return df.withColumn("leverage", sum((names[i] * names[j] * float(inverse[i, j]) for i in range(size) for j in range(size)), F.lit(0.0)))


def with_studentised(df: DataFrame, components: int, y: str = "y", p: str = "p") -> DataFrame:
    """Residual over s sqrt(1 - leverage), null where the leverage is 1 or no degree of freedom is left."""
    got = df.agg(F.count("*").alias("n"), F.sum((F.col(y) - F.col(p)) ** 2).alias("sse")).first()
    free = got["n"] - components - 1
    if free <= 0:
        return df.withColumn("studentised", F.lit(None).cast("double"))
    room = 1 - F.col("leverage")
    return df.withColumn("studentised", F.when(room > 1e-12, (F.col(y) - F.col(p)) / (float(np.sqrt(got["sse"] / free)) * F.sqrt(room))))


def flags(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """sample_idx, broken (names of rules), n_broken of the samples that break any: |value| strictly over the limit; most first, then by row."""
    broken = F.array_compact(F.array(*[F.when(F.abs(F.col(c)) > limit, F.lit(name)) for name, (c, limit) in rules.items()]))
    return df.select("sample_idx", broken.alias("broken")).where(F.size("broken") > 0).withColumn("n_broken", F.size("broken")).orderBy(F.desc("n_broken"), "sample_idx")


def robust(df: DataFrame, components: int | None = None, t: str = "t", starts: int = 500, seed: int = 0, most_rows: int = 1500, best: int = 10, most_steps: int = 50) -> DataFrame:
    """sample_idx, d2: squared robust distances of scores by the minimum covariance determinant.

    A sample of at most ``most_rows`` rows, by hash, gives the ``best`` of
    ``starts`` random starts after two concentration steps each.  They
    concentrate further over all rows: in each step the h nearest rows of each,
    by a percentile of the distances, give its next mean and covariance, all in
    sums that Spark adds up.  The one of least determinant is reweighted once.
    The percentile is exact up to 100,000 rows and within 1/100,000 of a rank
    beyond.
    """
    size = components or len(df.select(t).first()[0])
    rows = df.select("sample_idx", F.col(t).alias("t"))
    n = rows.count()
    h = -(-(n + size + 1) // 2)
    drawn = np.array([r.t for r in rows.select("sample_idx", "t", shuffled_key(seed, "sample_idx").alias("_key")).orderBy("_key", "sample_idx").limit(most_rows).collect()], float)
    if n <= size or np.linalg.matrix_rank(drawn - drawn.mean(0)) < size:
        raise Refused(f"{n} samples whose scores don't span {size} dimensions have no robust distance")
    found = kernels.concentrated(drawn, starts, seed, best)

    def distances(fits: list[tuple[np.ndarray, np.ndarray]]):
        inverse = [(m, np.linalg.pinv(c)) for m, c in fits]

        @F.pandas_udf("array<double>")
        def run(block: pd.Series) -> pd.Series:
            v = np.stack(block.to_list()).astype(float) if len(block) else np.zeros((0, size))
            return pd.Series(list(np.stack([((v - m) @ i * (v - m)).sum(1) for m, i in inverse], 1)))

        return run(F.col("t"))

    def moments(near: list, d: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mean and covariance of the rows within each limit."""
        v = lambda i: F.get("t", F.lit(i))
        sums = []
        for k, limit in enumerate(near):
            use = F.get("d", F.lit(k)) <= float(limit)
            sums += [F.avg(F.when(use, v(i))).alias(f"m{k}_{i}") for i in range(size)] + [F.covar_pop(F.when(use, v(i)), F.when(use, v(j))).alias(f"c{k}_{i}_{j}") for i in range(size) for j in range(i, size)]
        r = d.agg(*sums).first()
        return [(np.array([r[f"m{k}_{i}"] for i in range(size)]), np.array([[r[f"c{k}_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])) for k in range(len(near))]

    def ranked(d: DataFrame, rank: int, fits: int) -> list[float]:
        """The value of this rank, from 1, among each fit's distances."""
        return list(d.agg(*[F.percentile_approx(F.get("d", F.lit(k)), F.lit((rank - 0.5) / n), F.lit(100_000)).alias(f"p{k}") for k in range(fits)]).first())

    det = lambda fits: [np.linalg.slogdet(c)[1] for _, c in fits]
    worth = [np.inf] * len(found)
    for _ in range(most_steps):
        d = rows.withColumn("d", distances(found))
        new = moments(ranked(d, h, len(found)), d)
        if all(a >= b - 1e-12 for a, b in zip(det(new), worth, strict=True)):
            break
        found, worth = new, det(new)
    one = found[int(np.argmin(det(found)))]
    d = rows.withColumn("d", distances([one]))
    scale = quantiles.chi2(0.5, size) / ((ranked(d, (n + 1) // 2, 1)[0] + ranked(d, n // 2 + 1, 1)[0]) / 2)
    final = moments([quantiles.chi2(0.975, size) / scale], d)
    return rows.select("sample_idx", F.get(distances(final), F.lit(0)).alias("d2"))


def exclude(df: DataFrame, rows: list[int]) -> DataFrame:
    """The table without these samples, numbered anew from 0 in order."""
    if not rows:
        raise Refused("no sample is named")
    n, named = df.count(), set(rows)
    if min(named) < 0 or max(named) >= n or n - len(named) < 2:
        raise Refused(f"of {n} samples these can't be left out: {sorted(named)[:5]}")
    gone = np.array(sorted(named))

    @F.pandas_udf("bigint")
    def less(idx: pd.Series) -> pd.Series:
        before, after = np.searchsorted(gone, idx, "left"), np.searchsorted(gone, idx, "right")
        return pd.Series(np.where(after > before, -1, before))

    # The new number is the old one less the samples left out before it, so no sort and no join is needed.
    return df.withColumn("_less", less("sample_idx")).where("_less >= 0").withColumn("sample_idx", F.col("sample_idx") - F.col("_less")).drop("_less")


def by_class(df: DataFrame, label: str, components: int, x: str = "x", alpha: float = 0.05) -> DataFrame:
    """sample_idx, label, t2, t2_limit, spe, spe_limit, leverage, leverage_limit of each sample in its own class's components.

    One pass for all classes' R factors, one for the scores.  A class of n
    samples has at most n - 2 components, which its limits need; fewer than
    three samples are refused.
    """
    from .decomposition import class_models, limits, row_distances

    models = {}
    for name, g in class_models(df, label, x).items():
        if g.n < 3:
            raise Refused(f"class {name} has {g.n} samples")
        a = min(components, g.n - 2)
        model = kernels.pca(g.centred, a, g.n)
        models[name] = (g.mean, model, limits(model, alpha), a)

    def run(batches):
        for pdf in batches:
            out = np.zeros((6, len(pdf)))
            for name in pdf["label"].unique():
                mean, model, top, a = models[name]
                at = np.flatnonzero(pdf["label"] == name)
                t2, spe = row_distances(np.stack(pdf["x"].iloc[at].to_list()).astype(float), mean, model)
                # scores are centred and uncorrelated, so [1, t] has a diagonal Gram matrix
                out[:, at] = t2, np.full(len(at), top["t2"]), spe, np.full(len(at), top["spe"]), 1 / model.n + t2 / (model.n - 1), np.full(len(at), 3 * (a + 1) / model.n)
            yield pdf[["sample_idx", "label"]].assign(**dict(zip(("t2", "t2_limit", "spe", "spe_limit", "leverage", "leverage_limit"), out, strict=True)))

    rows = df.where(F.col(label).isNotNull()).select("sample_idx", F.col(label).alias("label"), F.col(x).alias("x"))
    return rows.mapInPandas(run, f"sample_idx bigint, label {dict(df.dtypes)[label]}, t2 double, t2_limit double, spe double, spe_limit double, leverage double, leverage_limit double")
