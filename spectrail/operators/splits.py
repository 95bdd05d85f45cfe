"""Resampling splits as tables of (fold, sample_idx) held out; training rows are the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

from .order import numbered, shuffled_key


def _count(df: DataFrame) -> int:
    n = df.count()
    if n < 2:
        raise Refused(f"{n} samples can't be split")
    return n


def _folds(n: int, k: int):
    """Of positions 0 to n - 1 in column pos, k runs of which the first n % k are one longer."""
    if not 2 <= k <= n:
        raise Refused(f"{n} samples can't make {k} folds")
    size, extra = divmod(n, k)
    pos = F.col("pos")
    return F.when(pos < extra * (size + 1), F.floor(pos / (size + 1))).otherwise(F.floor((pos - extra * (size + 1)) / size) + extra).cast("int")


def _positions(df: DataFrame, n: int, seed: int | None, order: str = "numpy") -> DataFrame:
    """sample_idx (0 to n - 1) with its place in a seeded permutation, or itself.

    order "numpy" is NumPy's permutation of that seed, so that folds can be
    repeated elsewhere; it is drawn on the driver, eight bytes a sample, for
    tables of up to some millions.  "hash", for tables of any size, ranks rows by
    a hash of seed and sample_idx, dealt by ranges.
    """
    if seed is None:
        return df.select("sample_idx", F.col("sample_idx").alias("pos"))
    if order == "hash":
        return numbered(df.select("sample_idx", shuffled_key(seed, "sample_idx").alias("_key")), "_key", "sample_idx", into="pos").drop("_key")
    if order != "numpy":
        raise Refused(f"the order {order} isn't known")
    import pandas as pd

    place = pd.DataFrame({"sample_idx": np.random.default_rng(seed).permutation(n).astype("int64"), "pos": np.arange(n, dtype="int64")})
    return df.select("sample_idx").join(df.sparkSession.createDataFrame(place), "sample_idx")


def k_fold(df: DataFrame, n_splits: int, shuffle: bool = True, seed: int = 42, order: str = "numpy") -> DataFrame:
    """fold, sample_idx: each sample is held out once.  order: see _positions."""
    n = _count(df)
    return _positions(df, n, seed if shuffle else None, order).select(_folds(n, n_splits).alias("fold"), "sample_idx")


def leave_one_out(df: DataFrame) -> DataFrame:
    if _count(df) > 2**31 - 1:
        raise Refused("as many folds as that have no number")
    return df.select(F.col("sample_idx").cast("int").alias("fold"), "sample_idx")


def train_test(df: DataFrame, test_size: float = 0.25, shuffle: bool = True, seed: int = 42, order: str = "numpy") -> DataFrame:
    """One fold; the first ceil(test_size * n) of the permutation are held out."""
    n = _count(df)
    held = int(np.ceil(test_size * n))
    if not 0 < held < n:
        raise Refused(f"a test size of {test_size} leaves one side of {n} samples empty")
    return _positions(df, n, seed if shuffle else None, order).where(F.col("pos") < held).select(F.lit(0).alias("fold"), "sample_idx")


def stratified_k_fold(df: DataFrame, level: str, n_splits: int, seed: int | None = None) -> DataFrame:
    """Levels in Unicode order end to end, each in a seeded order if a seed is given; the fold is the place modulo n_splits."""
    small = df.groupBy(level).count().where("count < 2").limit(1).collect()
    if small:
        raise Refused(f"level {small[0][0]} has one sample")
    rows = df.select("sample_idx", level, (F.col("sample_idx") if seed is None else shuffled_key(seed, "sample_idx")).alias("_key"))
    return numbered(rows, level, "_key", "sample_idx", into="_pos").select(F.pmod("_pos", F.lit(n_splits)).cast("int").alias("fold"), "sample_idx")


def stratified_train_test(df: DataFrame, level: str, test_size: float = 0.25) -> DataFrame:
    """The first ceil(test_size * n) samples of each level; a level that would be emptied is refused."""
    placed = numbered(df.select("sample_idx", level), level, "sample_idx", into="_pos")
    sizes = placed.groupBy(level).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    bad = sizes.where(F.ceil(test_size * F.col("_n")) >= F.col("_n")).limit(1).collect()
    if bad:
        raise Refused(f"level {bad[0][0]} would have no training sample")
    held = F.col("_pos") - F.col("_first") < F.ceil(test_size * F.col("_n"))
    return placed.join(sizes, level).where(held).select(F.lit(0).alias("fold"), "sample_idx")


def by_group(df: DataFrame, group: str, split, **options) -> DataFrame:
    """A split of the distinct groups, in Unicode order, spread to their rows."""
    folds = of_groups(numbered(df.select(group).distinct(), group), split, **options)
    return df.select("sample_idx", group).join(folds, group).select("fold", "sample_idx")


def of_groups(groups: DataFrame, split, **options) -> DataFrame:
    """``fold`` and the group of a table of groups numbered from 0."""
    return split(groups.select("sample_idx"), **options).join(groups, "sample_idx").drop("sample_idx")


def repeated_k_fold(df: DataFrame, n_splits: int, n_repeats: int, seed: int = 42) -> DataFrame:
    """k_fold with seeds seed, seed + 1, and so on; folds count on.  Beyond the reference, which only names it."""
    parts = [k_fold(df, n_splits, True, seed + r).withColumn("fold", F.col("fold") + r * n_splits) for r in range(n_repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def folds_from_indices(spark: SparkSession, held_out: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(k, i) for k, rows in enumerate(held_out) for i in rows], "fold int, sample_idx bigint")


def validate_partition(df: DataFrame, folds: DataFrame) -> None:
    """Refuses folds that don't hold out every sample exactly once."""
    wrong = df.select("sample_idx").join(folds.groupBy("sample_idx").count(), "sample_idx", "full_outer").where("coalesce(count, 0) <> 1").limit(1).collect()
    extra = folds.join(df.select("sample_idx"), "sample_idx", "left_anti").limit(1).collect()
    if wrong or extra:
        raise Refused(f"sample {(wrong or extra)[0]['sample_idx']} isn't held out exactly once")


def with_roles(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Every sample in every fold, with its role; the folds' numbers are few."""
    each = df.crossJoin(F.broadcast(folds.select("fold").distinct()))
    held = folds.withColumn("role", F.lit("test"))
    return each.join(held, ["fold", "sample_idx"], "left").withColumn("role", F.coalesce("role", F.lit("train")))
