"""Metrics as aggregations; what has no value is null, never 0 or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def regression(n_components: int = 0, y: str = "y", p: str = "p", mean: str | None = None) -> dict[str, Column]:
    """rmse, bias, r2, sec, sep and r2_pearson of observed y and predicted p.  mean: a column with the mean of y for SST, else the group's."""
    e, n = F.col(y) - F.col(p), F.count(y)
    sse, bias = F.sum(e * e), F.avg(e)
    sst = F.sum((F.col(y) - F.col(mean)) ** 2) if mean else F.var_pop(y) * n
    free = n - n_components - 1
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": bias,
        "r2": F.when(sst > 0, 1 - sse / sst),
        "sec": F.when(free > 0, F.sqrt(F.greatest(sse - n * bias * bias, F.lit(0.0)) / free)),
        "sep": F.stddev_samp(e),
        "r2_pearson": F.when((F.var_pop(y) > 0) & (F.var_pop(p) > 0), F.corr(y, p) ** 2),
    }


def regression_metrics(df: DataFrame, by: list[str] | None = None, n_components: int = 0) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in regression(n_components).items()])


def cross_validation(df: DataFrame, fold: str = "fold") -> DataFrame:
    """rmsecv of each fold and, fold null, the pooled one, q2 and the spread of the folds' errors."""
    e2 = (F.col("y") - F.col("p")) ** 2
    folds = df.groupBy(fold).agg(F.count("*").alias("n"), F.sqrt(F.avg(e2)).alias("rmsecv"), F.sum(e2).alias("sse"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"))
    spread = folds.agg(F.sum("n").alias("n"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmsecv"), (1 - F.sum("sse") / (F.sum("syy") - F.sum("sy") ** 2 / F.sum("n"))).alias("q2"), F.coalesce(F.stddev_samp("rmsecv"), F.lit(0.0)).alias("rmsecv_std"))
    none = F.lit(None).cast("double")
    return folds.select(fold, "n", "rmsecv", none.alias("q2"), none.alias("rmsecv_std")).unionByName(spread.select(F.lit(None).cast("int").alias(fold), "n", "rmsecv", "q2", "rmsecv_std"))


def confusion(df: DataFrame, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """observed, predicted, n for every pair of the classes that occur, zeros included."""
    classes = df.select(F.col(observed).alias("c")).unionByName(df.select(F.col(predicted).alias("c"))).distinct()
    spine = classes.select(F.col("c").alias("observed")).crossJoin(F.broadcast(classes.select(F.col("c").alias("predicted"))))  # classes are few
    counts = df.groupBy(F.col(observed).alias("observed"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["observed", "predicted"], "left").select("observed", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_metrics(df: DataFrame, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """n, sensitivity, specificity and precision of each class against the rest."""
    c = confusion(df, observed, predicted).withColumn("hit", F.when(F.col("observed") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col("observed").alias("class")).agg(F.sum("n").alias("n"), F.sum("hit").alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("assigned"))
    all_ = c.agg(F.sum("n").alias("total"))
    out = rows.join(cols, "class").crossJoin(F.broadcast(all_))
    tn = F.col("total") - F.col("n") - F.col("assigned") + F.col("tp")
    return out.select("class", "n", _ratio(F.col("tp"), F.col("n")).alias("sensitivity"), _ratio(tn, F.col("total") - F.col("n")).alias("specificity"), _ratio(F.col("tp"), F.col("assigned")).alias("precision"))


def accuracy(df: DataFrame, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(observed) == F.col(predicted)).cast("double")).alias("accuracy"))
