"""Column helpers for rows that hold a spectrum: sample_idx BIGINT, x ARRAY<DOUBLE>."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """An input that has no defined result; the message names the place."""


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row even where use puts it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def block(fn: Callable[[np.ndarray], np.ndarray], x: str = "x") -> Column:
    """fn over blocks of rows as a matrix; rows of one width, refused otherwise."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return rows
        if len({len(r) for r in rows}) > 1:
            raise Refused("rows of different widths")
        return pd.Series(list(fn(np.stack(rows.to_list()).astype(float))))

    return run(F.col(x))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of arrays as a matrix; rows of one width, refused otherwise."""
    if not len(column):
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or widths.min() < widths.max():
        raise Refused("rows of different widths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def list_of(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of arrays."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]), np.ascontiguousarray(rows, float).ravel())


def long(df: DataFrame, x: str = "x") -> DataFrame:
    """Rows of sample_idx, var_idx, value."""
    return df.select("sample_idx", F.posexplode(x).alias("var_idx", "value"))


def finite(df: DataFrame, x: str = "x") -> DataFrame:
    """The rows, failing on the first spectrum that is null or has a null, NaN or infinite value."""
    bad = F.col(x).isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.withColumn(x, F.when(bad, F.raise_error(F.concat(F.lit("sample "), F.col("sample_idx").cast("string"), F.lit(": the spectrum has a value that isn't finite")))).otherwise(F.col(x)))
