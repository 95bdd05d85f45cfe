"""Scoring of spectra as they arrive: fitted parameters are frozen, so no state is kept.  An extension of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.operators.decomposition import limits, with_scores
from spectrail.operators.preprocess import Step


def monitored(stream: DataFrame, steps: list[Step], model, mean, alpha: float = 0.05) -> DataFrame:
    """The stream with t2, spe and whether either lies over its limit for new samples."""
    for s in steps:
        stream = s.transform(stream)
    top = limits(model, alpha, new=True)
    return with_scores(stream, model, mean).withColumn("flagged", (F.col("t2") > top["t2"]) | (F.col("spe") > top["spe"]))


def flag_rate(scored: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Share of flagged samples in each window of event time; later ones than ``late`` are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(F.col("flagged").cast("double")).alias("flagged"))
