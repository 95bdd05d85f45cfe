"""Append-only catalog tables (datasets, pipelines, experiments, models) and the reads they serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline import Pipeline

EXPERIMENT = "experiment_id string, pipeline string, version string, metrics map<string,double>, status string, created_at timestamp"


def append(rows: DataFrame, warehouse: str, table: str) -> None:
    """Rows are added; nothing is changed in place, so writers don't meet."""
    rows.write.mode("append").parquet(f"{warehouse}/{table}")


def latest(table: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the one of the largest tie column."""
    columns = [c for c in table.columns if c != key]
    newest = table.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def history(table: DataFrame, at: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first, ties by id; a limit is a top-k that no task sorts whole."""
    out = table.orderBy(F.desc(at), tie)
    return out.limit(limit) if limit else out


def versions_of(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Each dataset with its versions, oldest first."""
    listed = versions.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("version", "version_id"))).alias("versions"))
    return datasets.join(listed, "dataset_id", "left")


def stored_matrix(df: DataFrame, pipeline: Pipeline, node: str, version: str, warehouse: str) -> DataFrame:
    """The rows of ``node``, which ``df`` must be, under its recipe key: read if they are stored whole, else written first.

    A folder without the mark that Spark leaves when all tasks have committed
    is what a lost job left, and is written anew.
    """
    spark: SparkSession = df.sparkSession
    path = f"{warehouse}/nodes/{pipeline.keys(version)[node].split(':')[1]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
