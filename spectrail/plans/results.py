"""What a fit is judged by, as a table of named numbers; null where a number has no value."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.operators import crossval, metrics, regression
from spectrail.operators.factors import training_sets

#: The form of a result: its set (calibration, cross_validation, a class), the number's name, and the number.
SCHEMA = "part string, metric string, value double"


def _long(df: DataFrame, part, names: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return df.select(part.alias("part"), F.explode(F.array(*pairs)).alias("p")).select("part", "p.metric", "p.value")


def regression_result(df: DataFrame, y: str, fit: regression.Fit, chosen: int, free: int | None = None, fold: str = "fold", x: str = "x") -> DataFrame:
    """part, metric, value of the model in row ``chosen`` (from 0) of a fit's coefficients.

    calibration: n, rmsec, bias, r2, sec (``free`` parameters, by default
    chosen + 1) and r2_pearson of the fit on all rows.  cross_validation: rmsecv,
    q2 and rmsecv_std of the held-out predictions, rmsecv_a1, rmsecv_a2, ... of
    every row of coefficients, and rmsecv_fold_0, rmsecv_fold_1, ...
    """
    m, _ = training_sets(df, [y], fold, x)
    own = regression.predict(df.select(F.col(y).cast("double").alias("y"), F.col(x).alias("x")), fit(m)[chosen], m.x_mean, float(m.y_mean[0]))
    inside = metrics.regression_metrics(own, n_components=chosen + 1 if free is None else free).withColumnRenamed("rmse", "rmsec")
    parts = [_long(inside, F.lit("calibration"), ["n", "rmsec", "bias", "r2", "sec", "r2_pearson"])]
    held = regression.cross_validated(df, y, fit, fold, x)
    folds = metrics.cross_validation(held.withColumn("p", F.get("yhat", F.lit(chosen))))
    parts.append(_long(folds.where(F.col("fold").isNull()), F.lit("cross_validation"), ["rmsecv", "q2", "rmsecv_std"]))
    parts.append(folds.where(F.col("fold").isNotNull()).select(F.lit("cross_validation").alias("part"), F.concat(F.lit("rmsecv_fold_"), "fold").alias("metric"), F.col("rmsecv").alias("value")))
    curve = held.select("y", F.posexplode("yhat").alias("pos", "p")).groupBy("pos").agg(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("value"))
    parts.append(curve.select(F.lit("cross_validation").alias("part"), F.concat(F.lit("rmsecv_a"), (F.col("pos") + 1).cast("string")).alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)


def classifier_result(df: DataFrame, label: str, build: crossval.Builder, fold: str = "fold", x: str = "x") -> DataFrame:
    """part, metric, value of held-out predictions: n and accuracy of all, and n, sensitivity, specificity and precision of each class."""
    held = crossval.cross_validated(df, label, build, fold, x)
    whole = _long(metrics.accuracy(held), F.lit("cross_validation"), ["n", "accuracy"])
    each = metrics.class_metrics(held)
    return whole.unionByName(_long(each, F.concat(F.lit("class "), F.col("class").cast("string")), ["n", "sensitivity", "specificity", "precision"]))


def tuning_result(df: DataFrame, y: str, kind: str, points: int = 25, l1_ratio: float = 0.5, fold: str = "fold", x: str = "x") -> DataFrame:
    """alpha, rmsecv, q2 over the default grid of ridge or elastic_net, which comes from all rows' R factor."""
    m, _ = training_sets(df, [y], fold, x)
    grid = regression.ridge_grid(m, points) if kind == "ridge" else regression.elastic_net_grid(m, l1_ratio, points)
    fit = regression.ridge_path(grid) if kind == "ridge" else regression.elastic_net_path(grid, l1_ratio)
    curve = regression.rmsecv_curve(df, y, fit, fold, x)
    return curve.select(F.get(F.lit(np.array(grid, float).tolist()), (F.col("a") - 1).cast("int")).alias("alpha"), "rmsecv", "q2")
