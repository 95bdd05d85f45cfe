"""Cut lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch; Python workers and the JVM hold a few of them for each task.
BATCH_BYTES = 8 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Where no folder is set and Spark runs in one process, the folder made for it.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and Spark runs in one process, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table; what computed them isn't run again if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts that go to Python by BATCH_BYTES, in sessions that have Spark's own bound (64 MB)."""
    if spark.conf.get(_BOUND).rstrip("b") == str(64 << 20):
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def dropped(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing will read any more."""
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("table-"):
            at = hadoop(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
