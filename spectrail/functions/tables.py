"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .arrays import Refused

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and Spark runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise Refused("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-rows-")
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing will read any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("rows-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
