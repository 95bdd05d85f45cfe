"""Fitted models that outlive the session: saved as a Parquet table, applied to batches and streams alike."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail.functions.arrays import Refused
from spectrail.operators import scorers
from spectrail.operators.preprocess import Step, from_spec, fused, to_spec

#: Version of the stored form; newer ones are refused.
VERSION = 2
_FRONT = {"x_mean", "loadings"}
_MACHINE = _FRONT | {"points", "beta", "constants", "gamma", "linear"}
#: The arrays of each kind, what scores with them, and what the scores mean: a value, or classes of which the largest or the least counts.
KINDS = {
    "regression": ({"b", "x_mean", "y_mean"}, scorers.linear, "value"),
    "classes": ({"b", "x_mean", "y_mean"}, scorers.linear, "largest"),
    "components": (_FRONT | {"eigenvalues", "limits"}, scorers.components, "distances"),
    "simca": ({"means", "loadings", "eigenvalues", "limits"}, scorers.simca, "least"),
    "discriminant": (_FRONT | {"centres", "inverses", "constants"}, scorers.discriminant, "largest"),
    "logistic": (_FRONT | {"weights", "constants"}, scorers.logistic, "largest"),
    "neighbours": (_FRONT | {"points", "of", "k", "n_classes"}, scorers.neighbours, "largest"),
    "machines": (_MACHINE | {"pairs", "n_classes"}, scorers.machines, "largest"),
    "kernel_regression": (_MACHINE, scorers.kernel_regression, "value"),
}


@dataclass
class Model:
    """A chain of fitted steps and what is applied behind it.

    regression: p = (x - x_mean) b + y_mean.  classes: the same with a column
    for each class, the largest counts (of two classes one column, cut at 0.5).
    components: scores t, t2 and spe, and whether either lies over its limit.
    simca: the class of least distance, and all classes that accept the row.
    The others score each class, the largest counts, ties go to the first.
    """

    kind: str
    arrays: dict[str, np.ndarray]
    steps: list[Step] = field(default_factory=list)
    axis: list[float] = field(default_factory=list)
    classes: list = field(default_factory=list)
    about: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise Refused(f"models of kind {self.kind} aren't known")
        if missing := KINDS[self.kind][0] - self.arrays.keys():
            raise Refused(f"a model of kind {self.kind} needs {', '.join(sorted(missing))}")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for the manifest and one for each array.  The folder must be new."""
        manifest = {"version": VERSION, "kind": self.kind, "steps": [to_spec(s) for s in self.steps], "axis": list(self.axis), "classes": list(self.classes), "about": self.about}
        rows = [("manifest", json.dumps(manifest, sort_keys=True), [], [])] + [(k, "", list(np.shape(v)), np.ravel(v).astype(float).tolist()) for k, v in self.arrays.items()]
        spark.createDataFrame(rows, "name string, text string, shape array<int>, values array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # a manifest and a few arrays
        if "manifest" not in rows:
            raise Refused(f"{path} holds no model")
        m = json.loads(rows.pop("manifest")["text"])
        if m["version"] > VERSION:
            raise Refused(f"the model has version {m['version']}, known are versions up to {VERSION}")
        arrays = {k: np.array(r["values"]).reshape(r["shape"]) for k, r in rows.items()}
        return cls(m["kind"], arrays, [from_spec(s) for s in m["steps"]], m["axis"], m["classes"], m["about"])

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and constants on the raw variables, where all steps are affine; a step that isn't is refused by name."""
        if self.kind not in ("regression", "classes"):
            raise Refused(f"a model of kind {self.kind} has no coefficients of a response")
        b, width = self.arrays["b"].reshape(len(self.arrays["x_mean"]), -1), len(self.axis)
        m, c = fused(self.steps, width or len(b))
        return m @ b, (c - self.arrays["x_mean"]) @ b + np.atleast_1d(self.arrays["y_mean"])

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """The rows, a stream's as well, with p; or predicted and scores (and accepted); or t, t2, spe and flagged.  Parameters are frozen, so no state is kept."""
        raw, (_, scorer, meaning) = "_raw_x", KINDS[self.kind]
        df = df.withColumn(raw, F.col(x))
        for s in self.steps:
            df = s.transform(df)
        run, a = scorer(self.arrays), self.arrays

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(x)
                width = len(rows[0]) if len(rows) else 0
                if (np.diff(rows.offsets.to_numpy()) != width).any():
                    raise Refused("rows of different widths")
                values = run(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width).astype(float)) if len(rows) else np.zeros((0, 1))
                ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], [*batch.schema.names, "scores"])

        # A node of its own: a stream doesn't evaluate Python functions of expressions that may raise errors, as the steps' do.
        df = df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])).withColumn(x, F.col(raw)).drop(raw)
        if meaning == "value":
            return df.withColumn("p", F.get("scores", F.lit(0))).drop("scores")
        if meaning == "distances":
            n = a["loadings"].shape[1]
            out = df.withColumns({"t": F.slice("scores", 1, n), "t2": F.get("scores", F.lit(n)), "spe": F.get("scores", F.lit(n + 1))}).drop("scores")
            return out.withColumn("flagged", (F.col("t2") > float(a["limits"][0])) | (F.col("spe") > float(a["limits"][1])))
        best = F.array_min("scores") if meaning == "least" else F.array_max("scores")
        first = F.array_position("scores", best) - 1
        pick = F.when(F.size("scores") == 1, F.when(F.get("scores", F.lit(0)) >= 0.5, 1).otherwise(0)).otherwise(first)
        df = df.withColumn("predicted", F.get(F.lit(self.classes), pick.cast("int")))
        if meaning == "least":
            df = df.withColumn("accepted", F.array_compact(F.array(*[F.when(F.get("scores", F.lit(k)) <= 1, F.lit(c)) for k, c in enumerate(self.classes)])))
        return df
