"""Exact nearest neighbours by pivots: the triangle inequality cuts blocks of training rows that can't hold one of the k nearest.

Training rows are dealt to their nearest pivot and cut by distance from it into
blocks of bounded size, each described by its pivot and the range of distances.
A query first meets the blocks that it takes to see k rows near it, which bounds
its k-th distance; then only blocks whose range comes within that bound.  A
block and a bounded number of queries meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused
from spectrail.functions.tables import written

from .order import shuffled_key

#: Most pivots; rows of a block; queries that meet a block in one task; most blocks, whose ranges go to every task.
PIVOTS, BLOCK_ROWS, QUERY_ROWS, MOST_BLOCKS = 256, 1024, 4096, 100_000
_FOUND = "sample_idx bigint, neighbour bigint, label {kind}, d2 double"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _to_pivots(pivots: np.ndarray):
    @F.pandas_udf("pivot int, d double")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        pivot, d = np.zeros(len(rows), np.int32), np.zeros(len(rows))
        for lo in range(0, len(rows), 2048):
            d2 = squared_distances(np.stack(rows.iloc[lo : lo + 2048].to_list()).astype(float), pivots)
            pivot[lo : lo + 2048], d[lo : lo + 2048] = d2.argmin(1), np.sqrt(d2.min(1))
        return pd.DataFrame({"pivot": pivot, "d": d})

    return nearest


def _blocks(train: DataFrame, rows: int, pivots: int, block_rows: int) -> tuple[np.ndarray, DataFrame, pd.DataFrame]:
    """The pivots; the training rows with their block; and of each block its pivot, least and largest distance and number of rows.

    Bounds of distance come from each pivot's approximate quantiles, fixed before
    rows are dealt.  Rows at one and the same distance stay together.
    """
    n = max(1, min(pivots, int(np.sqrt(rows) / 2)))
    drawn = train.select("x", shuffled_key(17, "sample_idx").alias("_key"), "sample_idx").orderBy("_key", "sample_idx").limit(n).collect()
    points = np.unique(np.array([r["x"] for r in drawn], float), axis=0)
    near = written(train.withColumn("_n", _to_pivots(points)(F.col("x"))).select("sample_idx", "label", "x", "_n.pivot", "_n.d"))
    size = max(block_rows, -(-rows // (MOST_BLOCKS // 2)))
    sizes = near.groupBy("pivot").agg(F.count("*").alias("n")).collect()  # a row a pivot
    most = max(-(-r["n"] // size) for r in sizes)
    cuts = {r["pivot"]: sorted(set(r["cuts"])) for r in near.groupBy("pivot").agg(F.percentile_approx("d", F.lit([k / most for k in range(1, most)]), 20 * most).alias("cuts")).collect()} if most > 1 else {}
    wanted = {r["pivot"]: -(-r["n"] // size) for r in sizes}
    held = {p: np.array(c)[np.unique(np.linspace(0, len(c), wanted[p] + 1)[1:-1].astype(int))] for p, c in cuts.items() if wanted[p] > 1}
    first = dict(zip(sorted(wanted), np.cumsum([0, *[len(held.get(p, ())) + 1 for p in sorted(wanted)]]).tolist(), strict=False))

    @F.pandas_udf("int")
    def block(pivot: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([first[p] + int(np.searchsorted(held[p], v, "right")) if p in held else first[p] for p, v in zip(pivot, d, strict=True)], index=pivot.index, dtype="int32")

    dealt = near.withColumn("block", block("pivot", "d"))
    ranges = dealt.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("d").alias("least"), F.max("d").alias("most"), F.count("*").alias("n")).toPandas().sort_values("block")  # MOST_BLOCKS rows
    return points, dealt, ranges


def _met(dealt: DataFrame, asked: DataFrame, k: int, kind: str, query_rows: int) -> DataFrame:
    """The k nearest rows of each asked block for each query of ``block, sample_idx, x``; a block is repeated for as many parts as its queries need."""
    sizes = asked.groupBy("block").agg(F.count("*").alias("_n")).select("block", F.ceil(F.col("_n") / query_rows).cast("int").alias("_parts"))
    left = dealt.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "sample_idx", "label", "x")
    right = asked.join(sizes, "block").select("block", F.pmod(F.xxhash64("sample_idx"), F.col("_parts")).cast("int").alias("part"), "sample_idx", "x")

    def nearest(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(q):
            return pd.DataFrame({"sample_idx": [], "neighbour": [], "label": [], "d2": []})
        a = a.sort_values("sample_idx")
        known, out = np.stack(a["x"].to_list()).astype(float), []
        for lo in range(0, len(q), 1024):
            part = q.iloc[lo : lo + 1024]
            d = squared_distances(np.stack(part["x"].to_list()).astype(float), known)
            at = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"sample_idx": np.repeat(part["sample_idx"].to_numpy(), at.shape[1]), "neighbour": a["sample_idx"].to_numpy()[at].ravel(), "label": a["label"].to_numpy()[at].ravel(), "d2": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(out)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(nearest, _FOUND.format(kind=kind))


def _asked(queries: DataFrame, points: np.ndarray, ranges: pd.DataFrame, k: int, reach: DataFrame | None) -> DataFrame:
    """``block, sample_idx, x`` of the blocks that a query must meet: without ``reach`` the nearest with k rows, with it all others that come within."""
    pivot, least, most, n = (ranges[c].to_numpy() for c in ("pivot", "least", "most", "n"))
    number = ranges["block"].to_numpy()
    at_once, homes = max(1, 1_000_000 // len(number)), reach is None
    rows = queries.select("sample_idx", "x", F.lit(None).cast("double").alias("reach")) if reach is None else queries.join(reach, "sample_idx").select("sample_idx", "x", "reach")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), at_once):
                part = pdf.iloc[lo : lo + at_once]
                d = np.sqrt(squared_distances(np.stack(part["x"].to_list()).astype(float), points))[:, pivot]
                low = np.maximum(np.maximum(least - d, d - most), 0)  # no row of the block is nearer
                order = np.lexsort((d + most, low))
                seen = np.take_along_axis(np.broadcast_to(n, d.shape), order, 1).cumsum(1)
                home = np.zeros(d.shape, bool)
                np.put_along_axis(home, order, seen - np.take_along_axis(np.broadcast_to(n, d.shape), order, 1) < k, 1)
                pick = home if homes else ~home & (low <= part["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9)
                q, b = np.nonzero(pick)
                yield pd.DataFrame({"block": number[b], "sample_idx": part["sample_idx"].to_numpy()[q], "x": part["x"].to_numpy()[q]})

    return rows.mapInPandas(run, "block int, sample_idx bigint, x array<double>")


def nearest_rows(train: DataFrame, queries: DataFrame, label: str, k: int, x: str = "x", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, pivots: int = PIVOTS, count: dict | None = None) -> DataFrame:
    """``sample_idx, rank, neighbour, label, d2``: the k nearest training rows of each query, at equal distances (to 12 places) the earlier row first.

    Exact whatever the pivots.  ``count``, if given, receives how many pairs of
    query and row the distances were computed for, and how many there are.
    """
    rows = train.count()
    if k > rows:
        raise Refused(f"k is {k}, more than the training samples")
    known = train.select("sample_idx", F.col(label).alias("label"), F.col(x).cast("array<double>").alias("x"))
    asked = queries.select("sample_idx", F.col(x).cast("array<double>").alias("x"))
    kind = dict(known.dtypes)["label"]
    points, dealt, ranges = _blocks(known, rows, pivots, block_rows)
    dealt = written(dealt)
    near = written(_asked(asked, points, ranges, k, None))
    found = written(_met(dealt, near, k, kind, query_rows))
    order = (F.round("d2", 12), F.col("neighbour"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("sample_idx").orderBy(*order))).where(F.col("rank") <= k)
    reach = ranked(found).groupBy("sample_idx").agg(F.sqrt(F.max("d2")).alias("reach"))
    rest = written(_asked(asked, points, ranges, k, reach))
    if count is not None:
        sizes = train.sparkSession.createDataFrame(ranges[["block", "n"]].astype("int64"))
        count["met"] = near.select("block").unionByName(rest.select("block")).join(F.broadcast(sizes), "block").agg(F.sum("n")).first()[0]
        count["all"] = rows * asked.count()
    whole = reduce(DataFrame.unionByName, [found, _met(dealt, rest, k, kind, query_rows)])
    return ranked(whole).select("sample_idx", "rank", "neighbour", "label", "d2")


def knn(train: DataFrame, queries: DataFrame, label: str, k: int, x: str = "x", **bounds) -> DataFrame:
    """``sample_idx, observed, predicted``: votes of the k nearest training rows; ties go to the first class."""
    votes = nearest_rows(train, queries, label, k, x, **bounds).groupBy("sample_idx", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("sample_idx").agg(F.min(F.struct(-F.col("votes"), F.col("label").alias("predicted"))).alias("b"))
    return queries.select("sample_idx", F.col(label).alias("observed")).join(best, "sample_idx").select("sample_idx", "observed", F.col("b.predicted").alias("predicted"))
