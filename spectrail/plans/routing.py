"""From a split's declaration to its folds: plain, by group or by strata, derived again whenever they are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused
from spectrail.functions.tables import written
from spectrail.operators import splits
from spectrail.operators.order import numbered

#: Options of each split; kinds that are declared only have no splitter.
OPTIONS = {
    "kfold": {"n_splits": 5, "shuffle": True, "seed": 42, "group_by": None, "stratify_by": None, "order": "hash"},
    "train_test": {"test_size": 0.25, "shuffle": True, "seed": 42, "group_by": None, "stratify_by": None, "order": "hash"},
    "loo": {"group_by": None},
}
DECLARED_ONLY = {"repeated_kfold", "external"}
#: Folds of leave-one-out beyond which a model for each of them is refused.
MOST_FOLDS = 5_000


def settled(kind: str, options: dict) -> dict:
    """A split's options with their defaults; refuses what has no splitter, unknown options, and both a group and strata."""
    if kind in DECLARED_ONLY:
        raise Refused(f"the split {kind} has no splitter")
    if kind not in OPTIONS:
        raise Refused(f"the split {kind} isn't known")
    if unknown := options.keys() - OPTIONS[kind].keys():
        raise Refused(f"{kind} has no option {', '.join(sorted(unknown))}")
    out = OPTIONS[kind] | options
    if out.get("group_by") is not None and out.get("stratify_by") is not None:
        raise Refused(f"{kind} splits by group or by strata, not by both")
    if kind == "kfold" and out["n_splits"] < 2:
        raise Refused("kfold needs two folds or more")
    if kind == "train_test" and not 0 < out["test_size"] < 1:
        raise Refused("train_test: test_size must lie between 0 and 1")
    return out


def _asked(df: DataFrame, kind: str, options: dict) -> tuple[dict, str | None, Callable[[DataFrame], DataFrame]]:
    """The settled options, the column that splits go by, and the plain split."""
    o = settled(kind, options)
    by = o.get("group_by") if o.get("group_by") is not None else o.get("stratify_by")
    if by is not None:
        others = sorted(set(df.columns) - {"sample_idx", "x"})
        if by not in others:
            raise Refused(f"{kind} splits by {by}, which isn't a column; there are {', '.join(others) or 'none'}")
        if not df.where(F.col(by).isNull()).isEmpty():
            raise Refused(f"{kind} splits by {by}, which is null in some rows")
    return o, by, {
        "kfold": lambda t: splits.k_fold(t, o["n_splits"], o["shuffle"], o["seed"], o["order"]),
        "train_test": lambda t: splits.train_test(t, o["test_size"], o["shuffle"], o["seed"], o["order"]),
        "loo": splits.leave_one_out,
    }[kind]


def held(df: DataFrame, kind: str, options: dict) -> tuple[DataFrame, str]:
    """``held`` beside the column that it goes by: a split by groups is one of the groups' table, any other one of samples."""
    o, by, plain = _asked(df, kind, options)
    if by is None or o.get("group_by") is None:
        return folds_of(df, kind, options).withColumnRenamed("fold", "held"), "sample_idx"
    groups = written(numbered(written(df.select(by).distinct()), by))
    found = written(splits.of_groups(groups, plain))
    if kind != "train_test":
        splits.validate_partition(groups, found.join(groups, by).select("fold", "sample_idx"))
    return found.withColumnRenamed("fold", "held"), by


def folds_of(df: DataFrame, kind: str, options: dict) -> DataFrame:
    """``fold, sample_idx`` held out, of a table with ``sample_idx`` from 0 to n - 1; every sample at most once, and for all but train_test exactly once."""
    o, by, plain = _asked(df, kind, options)
    rows = df.select("sample_idx", *([by] if by else []))
    seed = o.get("seed") if o.get("shuffle") else None
    if o.get("stratify_by") is not None:
        found = splits.stratified_k_fold(rows, by, o["n_splits"], seed) if kind == "kfold" else splits.stratified_train_test(rows, by, o["test_size"])
    else:
        found = plain(rows) if by is None else splits.by_group(rows, by, plain)
    if kind != "train_test":
        splits.validate_partition(rows, found)
    return found
