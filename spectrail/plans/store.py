"""What a pipeline's nodes leave behind: matrices by recipe key and fold, commits, per-sample results and models.

``matrices/key=K/fold=F`` has a node's rows: fold -1 is the matrix of all
samples, fold k the same samples through the parameters learned without fold k.
``commits/key=K`` is written last and says which folds and how many rows there
must be; a matrix without its commit, or with other folds or rows than it says,
is a miss.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fold of the matrix of all samples.
ALL = -1

@dataclass
class Commit:
    """A node's record.  rows: samples of each fold of its stored matrix, empty if it isn't stored; steps: the fitted step of each fold, as written down."""

    kind: str
    folds: list[int] | None = None
    rows: dict[int, int] = field(default_factory=dict)
    steps: dict[int, dict] = field(default_factory=dict)
    metrics: list[list] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)

    @property
    def versioned(self) -> bool:
        return len(self.steps) > 1 or len(self.rows) > 1

    def text(self) -> str:
        return json.dumps(vars(self), sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Commit:
        body = json.loads(text)
        return cls(**body | {k: {int(f): v for f, v in body[k].items()} for k in ("rows", "steps")})


@dataclass
class Store:
    spark: SparkSession
    path: str

    def commits(self, keys: set[str]) -> dict[str, Commit]:
        """The records of these keys whose matrices are whole: two small jobs, whatever the number of nodes."""
        try:
            rows = self.spark.read.schema("body string, key string").parquet(f"{self.path}/commits").where(F.col("key").isin(sorted(keys))).collect()
        except AnalysisException:
            return {}
        found = {r["key"]: Commit.of(r["body"]) for r in rows}
        stored = sorted(k for k, c in found.items() if c.rows)
        there: dict[str, dict[int, int]] = {k: {} for k in stored}
        if stored:
            try:
                table = self.spark.read.schema("sample_idx bigint, key string, fold int").parquet(f"{self.path}/matrices")
                for r in table.where(F.col("key").isin(stored)).groupBy("key", "fold").count().collect():
                    there[r["key"]][r["fold"]] = r["count"]
            except AnalysisException:
                pass
        return {k: c for k, c in found.items() if not c.rows or there[k] == c.rows}

    def commit(self, key: str, record: Commit) -> None:
        self.spark.createDataFrame([(record.text(),)], "body string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/key={key}")

    def write(self, key: str, rows: DataFrame) -> dict[int, int]:
        """Store rows with a column ``fold``; the samples of each fold."""
        path = f"{self.path}/matrices/key={key}"
        rows.write.mode("overwrite").partitionBy("fold").parquet(path)
        return {r["fold"]: r["count"] for r in self.read(key).groupBy("fold").count().collect()}

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/matrices/key={key}")
