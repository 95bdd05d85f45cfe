"""Positions and permutations of a table's rows without a global sort in one task."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most ranges of a numbering, and sampled rows a range from which their bounds come.
RANGES, SAMPLED = 4096, 20


def _rank(value) -> tuple:
    """A value in Spark's order among its column's: null first, NaN last."""
    return (0,) if value is None else (2,) if value != value else (1, value)


def _range_of(by: tuple[str, ...], bounds: list[tuple]) -> Column:
    """How many of the ascending bounds a row's key reaches: by the first column where it is a whole number that no bound shares, else by all."""
    if not bounds:
        return F.lit(0)
    whole = all(len(b[0]) == 2 and type(b[0][1]) is int for b in bounds)
    lead = np.array([b[0][1] for b in bounds], np.int64) if whole else None

    @F.arrow_udf("int")
    def reached(keys: pa.Array) -> pa.Array:
        columns = keys.flatten()
        if lead is None or columns[0].null_count:
            out, open_ = np.zeros(len(keys), np.int32), np.arange(len(keys))
        else:
            first = columns[0].to_numpy()
            out = np.searchsorted(lead, first, "right").astype(np.int32)
            open_ = np.flatnonzero(out > np.searchsorted(lead, first, "left"))
        ranked = [[_rank(v) for v in c.take(pa.array(open_)).to_pylist()] for c in columns]
        out[open_] = [bisect_right(bounds, key) for key in zip(*ranked, strict=True)]
        return pa.array(out)

    return reached(F.struct(*by))


def numbered(df: DataFrame, *by: str, into: str = "sample_idx", rows_a_range: int = 1_000_000) -> DataFrame:
    """Column ``into``: places from 0 in order of the columns ``by`` (null first).

    Bounds of ranges come from a sample by hash, about SAMPLED rows a range, and
    are fixed before the rows are dealt, so that counting and numbering see the
    same ranges whenever they run.  Each range numbers its own rows; the ranges'
    sizes give the offsets.  Rows that tie in all of ``by`` meet in one range,
    so end ``by`` with an id.
    """
    n = df.count()
    ranges, bounds = max(1, min(RANGES, math.ceil(n / rows_a_range))), []
    if ranges > 1:
        turn = F.pmod(F.xxhash64(F.lit("range"), *by), F.lit(1 << 30))
        drawn = df.where(turn < int(min(1.0, SAMPLED * ranges / n) * (1 << 30))).select(*by).distinct().orderBy(*by).toArrow()
        keys = list(zip(*([_rank(v) for v in c.to_pylist()] for c in drawn.columns), strict=True))
        bounds = [keys[k] for k in sorted({len(keys) * r // ranges for r in range(1, ranges)})] if keys else []
    alone = len({b[0] for b in bounds}) == len(bounds)  # no value of the first column fills a range, so it can deal the rows
    parts = df.withColumn("_part", _range_of(by[:1], [b[:1] for b in bounds]) if alone else _range_of(by, bounds))
    placed = parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1)
    offset, rows = 0, []
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        rows.append((r["_part"], offset))
        offset += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _offset bigint")  # a row for each range
    return placed.join(F.broadcast(offsets), "_part").withColumn(into, F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset")


def shuffled_key(seed: int, *columns: str) -> Column:
    """A pseudo-random 64-bit key of each row; its order is a permutation that a seed fixes."""
    return F.xxhash64(F.lit(seed), *columns)
