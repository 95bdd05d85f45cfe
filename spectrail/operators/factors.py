"""One R factor a fold: partial and final aggregation for every linear model, its cross-validation included.

The R factor of [1, X, y] over a fold's rows comes from the factors of its
partitions, stacked and factored again; it travels as a packed triangle.  Leaving a fold out stacks the factors
of the others, so K folds take one pass and no row is copied.  Sizes on the
driver depend on the number of variables and folds only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused, matrix_of


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """The R factor of all rows from those of parts of them."""
    return _triangle(np.concatenate(parts))


#: Bytes of packed factors that one task stacks at most, and that one folds' merge brings together; from them come the fan-in and levels of the tree.
TASK_BYTES = 256 << 20
#: Partitions that the tree is laid out for; more give its first level more to stack.
PARTITIONS = 4096
#: Variables beyond which each fold's model is fitted in a task of its own and only its coefficients come to the driver.
WIDE = 512


def packed(r: np.ndarray) -> bytes:
    """The upper triangle, row by row; rows below the diagonal's end are zeros and not kept."""
    rows, width = min(len(r), r.shape[1]), r.shape[1]
    return np.concatenate([r[i, i:] for i in range(rows)] or [np.zeros(0)]).astype("<f8").tobytes() if rows < width else r[np.triu_indices(width)].astype("<f8").tobytes()


def unpacked(body: bytes, width: int) -> np.ndarray:
    """The factor of ``packed``; its number of rows follows from its size."""
    flat = np.frombuffer(body, "<f8")
    rows, left = 0, len(flat)
    while left > 0:
        left -= width - rows
        rows += 1
    out = np.zeros((rows, width))
    at = 0
    for i in range(rows):
        out[i, i:] = flat[at : at + width - i]
        at += width - i
    return out


def levels_for(width: int) -> tuple[int, ...]:
    """Groups of each level of the merge tree, so that a task stacks factors of TASK_BYTES at most: one level for narrow tables, more for wide ones."""
    fan = max(2, TASK_BYTES // (4 * width * (width + 1)))
    if fan >= PARTITIONS // 32:
        return (32,)
    out, groups = [], PARTITIONS
    while groups > 1:
        groups = -(-groups // fan)
        out.append(groups)
    return tuple(g for g in out if g > 1)


_PACKED = "fold int, part int, n bigint, width int, r binary"
_PACKED_ARROW = pa.schema([("fold", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("r", pa.binary())])


def _rows(held: dict[int, tuple[int, np.ndarray]], part_id: int, extra: int) -> pd.DataFrame:
    return pd.DataFrame([{"fold": k, "part": part_id, "n": n, "width": r.shape[1] - extra, "r": packed(r)} for k, (n, r) in held.items()], columns=["fold", "part", "n", "width", "r"])


def factor(row, targets: int) -> tuple[int, np.ndarray]:
    """Rows and R factor of a row of ``fold_factors``."""
    return row.n, unpacked(row.r, row.width + targets + 1)


def fold_factors(df: DataFrame, targets: list[str], fold: str = "fold", x: str = "x", block: int = 2048, levels: tuple[int, ...] | None = None) -> DataFrame:
    """fold, n, width, r (the packed triangle) of [1, x, targets].

    The partitions' factors meet in a tree whose fan-in follows from their size,
    so that a task stacks a bounded number of bytes however wide the table is.
    """
    width = len(targets) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            of = batch.column(fold).to_numpy(zero_copy_only=False)
            values = np.column_stack([np.ones(len(batch)), matrix_of(batch.column(x)), *[batch.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False) for t in targets]])
            for k in np.unique(of[of == of]).astype(int).tolist():  # rows of no fold are left out
                at = np.flatnonzero(of == k)
                for lo in range(0, len(at), block):
                    rows = values[at[lo : lo + block]]
                    n, r = held.get(k, (0, rows[:0]))
                    held[k] = n + len(rows), stacked([r, rows])
        yield pa.RecordBatch.from_pandas(_rows(held, part_id, width), _PACKED_ARROW, preserve_index=False)

    rows = df.select(F.col(fold).cast("int").alias(fold), x, *targets)
    if levels is None:
        one = rows.select(F.size(x).alias("n")).first()
        levels = levels_for((one["n"] if one else 0) + width)
    return _merged(rows.mapInArrow(partial, _PACKED), width, levels)


def _merged(parts: DataFrame, width: int, levels: tuple[int, ...]) -> DataFrame:
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = int(pdf["width"].iloc[0])
        r = unpacked(pdf["r"].iloc[0], wide + width)
        for body in pdf["r"].iloc[1:]:  # two at a time: no more than a pair is unpacked
            r = stacked([r, unpacked(body, wide + width)])
        return pd.DataFrame([{"fold": key[0], "part": key[1], "n": int(pdf["n"].sum()), "width": wide, "r": packed(r)}])

    for groups in (*levels, 1):
        parts = parts.withColumn("part", F.col("part") % groups).groupBy("fold", "part").applyInPandas(merge, _PACKED)
    return parts.drop("part")


def weighted_factors(df: DataFrame, targets: list[str], weights: Callable[[np.ndarray], np.ndarray], x: str = "x", block: int = 2048, levels: tuple[int, ...] | None = None) -> DataFrame:
    """As fold_factors, the fold being a repeat: weights(sample_idx) has a row of whole weights for each repeat, n is their sum."""
    width = len(targets) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id = TaskContext.get().partitionId()
        held: dict[int, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), block):
                part = pdf.iloc[lo : lo + block]
                rows = np.column_stack([np.ones(len(part)), np.stack(part[x].to_list()), part[targets].to_numpy(float)])
                for k, w in enumerate(weights(part["sample_idx"].to_numpy())):
                    n, r = held.get(k, (0, rows[:0]))
                    held[k] = n + int(w.sum()), stacked([r, rows[w > 0] * np.sqrt(w[w > 0])[:, None]])
        yield _rows(held, part_id, width)

    if levels is None:
        one = df.select(F.size(x).alias("n")).first()
        levels = levels_for((one["n"] if one else 0) + width)
    return _merged(df.select("sample_idx", x, *targets).mapInPandas(partial, _PACKED), width, levels)


@dataclass
class Fitted:
    """Moments of some rows: n, means, and R factors of the centred variables and responses."""

    n: int
    x_mean: np.ndarray
    y_mean: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, np.ndarray]], targets: int) -> Fitted:
        n, r = sum(p[0] for p in parts), stacked([p[1] for p in parts])
        if n < 2:
            raise Refused("fewer than two training samples")
        mean, rest = r[0, 1:] / r[0, 0], r[1:, 1:]
        return cls(n, mean[:-targets], mean[-targets:], rest[:, :-targets], rest[:, -targets:])


def training_sets(df: DataFrame, targets: list[str], fold: str = "fold", x: str = "x") -> tuple[Fitted, dict[int, Fitted]]:
    """Moments of all rows, and of the rows outside each fold.  Each is a triangle of the variables' number; see ``fold_fits`` for wide tables."""
    got = {r.fold: factor(r, len(targets)) for r in fold_factors(df, targets, fold, x).collect()}
    if not got:
        raise Refused("no samples to fit on")
    whole = Fitted.of(list(got.values()), len(targets))
    return whole, {k: Fitted.of([v for j, v in got.items() if j != k], len(targets)) for k in got} if len(got) > 1 else {}


def fold_fits(df: DataFrame, targets: list[str], fit: Callable[[Fitted], np.ndarray], fold: str = "fold", x: str = "x") -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Coefficients, x means and y means of the fit outside each fold.

    Of a table of more than WIDE variables, each fold's factors meet in a task,
    are stacked two at a time and fitted there, and the driver sees coefficients
    only; narrow ones are fitted on the driver.
    """
    one = df.select(F.size(x).alias("n")).first()
    if one is None or one["n"] <= WIDE:
        _, folds = training_sets(df, targets, fold, x)
        return {k: (fit(m), m.x_mean, m.y_mean) for k, m in folds.items()}
    parts = fold_factors(df, targets, fold, x)
    numbers = [int(r[0]) for r in df.select(F.col(fold).cast("int")).distinct().orderBy(fold).collect()]

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide, total, r = int(pdf["width"].iloc[0]) + len(targets) + 1, 0, None
        for n, body in zip(pdf["n"], pdf["r"], strict=True):
            total, own = total + int(n), unpacked(body, wide)
            r = own if r is None else stacked([r, own])
        m = Fitted.of([(total, r)], len(targets))
        b = fit(m)
        return pd.DataFrame([{"fold": key[0], "rows": len(b), "b": b.ravel().tolist(), "x_mean": m.x_mean.tolist(), "y_mean": m.y_mean.tolist()}])

    spread = parts.withColumn("out", F.explode(F.lit(numbers))).where(F.col("out") != F.col("fold"))
    got = spread.groupBy("out").applyInPandas(fitted, "fold int, rows int, b array<double>, x_mean array<double>, y_mean array<double>").collect()
    return {r.fold: (np.array(r.b).reshape(r.rows, -1), np.array(r.x_mean), np.array(r.y_mean)) for r in got}
