"""Running a declared pipeline: nodes become Spark jobs that share their prefixes, are stored by recipe key, and are reused.

Below a split a step that learns from the samples is learned once for every fold
and once for all samples, in one pass: sums of each fold are merged without the
fold they leave out.  Until such a step the folds share one matrix, in which
``held`` names the fold that holds a sample out; from it on the matrix has a
version for each fold.  Only parameters reach the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused, finite, list_of, matrix_of
from spectrail.operators import preprocess as pre
from spectrail.operators.factors import Fitted, factor, fold_factors, stacked

from . import estimators, routing
from .pipeline import ESTIMATORS, SPLITS, Node, Pipeline
from .store import ALL, Commit, Store

#: The group of rows that no fold holds out.
NEVER = -2


class NodeFailed(Refused):
    """A node that couldn't be computed; ``node_id`` names it."""

    def __init__(self, node_id: str, why: object):
        super().__init__(f"node {node_id}: {why}")
        self.node_id = node_id


@dataclass
class Matrix:
    """A node's rows: sample_idx, x, the source's other columns; below a split ``held``, and ``fold`` if each fold has its own.

    Rows that aren't stored but come from the matrix ``above`` through ``steps``,
    one a version, are asked for there: nobody makes all versions to read one.
    """

    df: DataFrame
    folds: list[int] | None = None
    versioned: bool = False
    above: Matrix | None = None
    steps: dict[int, pre.Step] | None = None
    through: Callable[[DataFrame], DataFrame] | None = None

    def over(self, above: Matrix) -> Matrix:
        """The same steps over another matrix."""
        return _through(above, self.steps)

    @property
    def versions(self) -> list[int]:
        return [ALL, *(self.folds or [])]

    def everything(self) -> DataFrame:
        """Every sample through the parameters of all samples: what a final model is fitted to."""
        if self.above is not None:
            return self.through(self.above.everything().drop("fold").withColumn("fold", F.lit(ALL)))
        return self.df.where(F.col("fold") == ALL) if self.versioned else self.df

    def held_out(self) -> DataFrame:
        """The samples that a fold holds out, each through that fold's parameters, with ``fold``."""
        if self.above is not None:
            return self.through(self.above.held_out())
        if self.versioned:
            return self.df.where(F.col("fold") == F.col("held"))
        return self.df.where(F.col("held").isNotNull()).drop("fold").withColumn("fold", F.col("held"))

    def display(self) -> DataFrame:
        """Every sample once: below a split as its own fold's model sees it, and as that of all samples does if no fold holds it out."""
        return self.df.where(F.col("fold") == F.coalesce("held", F.lit(ALL))) if self.versioned else self.df

    def training(self) -> DataFrame:
        """Rows with ``fold``: of a versioned matrix each version's training rows; else each row with the fold that holds it out, or NEVER."""
        if self.versioned:
            return self.df.where((F.col("fold") == ALL) | F.col("held").isNull() | (F.col("held") != F.col("fold")))
        return self.df.drop("fold").withColumn("fold", F.coalesce("held", F.lit(NEVER)) if self.folds is not None else F.lit(NEVER))

    def pair(self, k: int) -> tuple[DataFrame, DataFrame]:
        """Training rows and held-out rows of a fold, or all samples twice."""
        if k == ALL:
            return self.everything(), self.everything()
        own = self.df.where(F.col("fold") == k) if self.versioned else self.df
        return own.where(F.col("held").isNull() | (F.col("held") != k)), own.where(F.col("held") == k)

    def _merged(self, parts: dict[int, object], merge: Callable[[list], object]) -> dict[int, object]:
        """Of the training rows' parts: one merged part for each version."""
        if self.versioned:
            return {k: merge([parts[k]]) for k in self.versions if k in parts}
        return {k: merge([p for j, p in parts.items() if j != k or k == ALL]) for k in self.versions}

    def factors(self, targets: list[str]) -> dict[int, Fitted]:
        """Means and R factors of variables and targets over each version's training rows, from one pass."""
        if self.above is not None and all(isinstance(s, pre.MeanCentre | pre.Autoscale) for s in self.steps.values()):
            moved = lambda f, s: Fitted(f.n, _rows_through(s, f.x_mean[None])[0], f.y_mean, f.x / s.scale if isinstance(s, pre.Autoscale) else f.x, f.y)
            return {k: moved(f, self.steps[k]) for k, f in self.above.factors(targets).items()}
        parts = {r.fold: factor(r, len(targets)) for r in fold_factors(self.training(), targets).collect()}
        return self._merged(parts, lambda p: Fitted.of(p, len(targets)))

    def groups(self, label: str, classes: list) -> dict[int, list[estimators.Group]]:
        """The same for the rows of each class; a version without rows of a class is refused."""
        rows, n = self.training().where(F.col(label).isNotNull()), len(classes)
        cell = (F.col("fold") - NEVER) * n + F.array_position(F.lit(classes), F.col(label)).cast("int") - 1
        cells: list[dict] = [{} for _ in classes]
        for r in fold_factors(rows.withColumn("_cell", cell), [], "_cell").collect():
            fold, c = divmod(r.fold, n)
            cells[c][fold + NEVER] = factor(r, 0)
        out: dict[int, list] = {k: [] for k in self.versions}
        for c, parts in enumerate(cells):
            merged = self._merged(parts, lambda p: estimators.Group(sum(n for n, _ in p), stacked([r for _, r in p])) if p else None)
            for k in self.versions:
                if merged.get(k) is None:
                    raise Refused(f"fold {k} trains without class {classes[c]}")
                out[k].append(merged[k])
        return out

    def statistics(self) -> dict[int, dict[str, np.ndarray]]:
        """n, mean, standard deviation (n - 1) and largest size of each variable over each version's training rows."""
        long = self.training().select("fold", F.posexplode("x").alias("var_idx", "value"))
        found: dict[int, list] = {}
        for r in long.groupBy("fold", "var_idx").agg(F.count("value"), F.avg("value"), F.var_pop("value"), F.max(F.abs("value"))).orderBy("fold", "var_idx").collect():  # a row a fold and variable
            found.setdefault(r[0], []).append(r[2:])

        def merge(parts: list[np.ndarray]) -> dict[str, np.ndarray]:
            if not parts:
                raise Refused("no training samples")
            n, mean, var, top = np.moveaxis(np.stack(parts), -1, 0)
            size = n.sum(0)
            middle = (n * mean).sum(0) / size
            spread = (n * (var + (mean - middle) ** 2)).sum(0)
            return {"n": size, "mean": middle, "std": np.sqrt(spread / np.maximum(size - 1, 1)), "top": top.max(0)}

        return self._merged({k: np.array(v, float) for k, v in found.items()}, merge)

    def medians(self) -> dict[int, np.ndarray]:
        """Exact medians of each variable over each version's training rows."""
        long = self.training().select("fold", F.posexplode("x").alias("var_idx", "value"))
        if self.versioned:
            out: dict[int, list] = {}
            for r in long.groupBy("fold", "var_idx").agg(F.median("value").alias("m")).orderBy("fold", "var_idx").collect():
                out.setdefault(r["fold"], []).append(r["m"])
            return {k: np.array(v) for k, v in out.items()}
        each = long.groupBy("var_idx").agg(*[F.median(F.when(F.col("fold") != k, F.col("value"))).alias(str(i)) for i, k in enumerate(self.versions)]).orderBy("var_idx").collect()
        return {k: np.array([r[str(i)] for r in each]) for i, k in enumerate(self.versions)}


def _fitted(step: pre.Step, m: Matrix) -> dict[int, pre.Step]:
    """The step as learned for each version of a matrix."""
    if isinstance(step, pre.MeanCentre):
        return {k: pre.MeanCentre(s["mean"]) for k, s in m.statistics().items()}
    if isinstance(step, pre.Autoscale):
        out = {}
        for k, s in m.statistics().items():
            scale = s["std"] * (1 if step.ddof else np.sqrt((s["n"] - 1) / s["n"]))
            pre._scaled(scale, s["top"])
            out[k] = pre.Autoscale(step.ddof, s["mean"], scale)
        return out
    if isinstance(step, pre.Msc):
        if step.reference == "supplied":
            return {k: step for k in m.versions}
        spectra = {k: s["mean"] for k, s in m.statistics().items()} if step.reference == "mean" else m.medians()
        return {k: pre.Msc("supplied", spectrum=s).fit(m.df) for k, s in spectra.items()}
    raise Refused(f"{type(step).__name__} can't be learned fold by fold")


def _rows_through(step: pre.Step, x: np.ndarray) -> np.ndarray:
    """A learned step on a block of rows."""
    if isinstance(step, pre.MeanCentre):
        return x - step.mean
    if isinstance(step, pre.Autoscale):
        return (x - step.mean) / step.scale
    r = step.spectrum - step.spectrum.mean()
    slope = (x - x.mean(1, keepdims=True)) @ r / (r @ r)
    if np.any(np.abs(slope) <= 8 * pre._EPS):
        raise Refused("zero slope in a row")
    return (x - (x.mean(1) - slope * step.spectrum.mean())[:, None]) / slope[:, None]


def _through(m: Matrix, steps: dict[int, pre.Step]) -> Matrix:
    """A matrix through a step learned for each version; lazy."""
    if m.folds is None:
        return Matrix(steps[ALL].transform(m.df))
    rows = m.df if m.versioned else m.df.drop("fold").withColumn("fold", F.explode(F.lit(m.versions)))
    shared = m.df.sparkSession.sparkContext.broadcast(steps)  # a few numbers a variable and fold

    @F.arrow_udf("array<double>")
    def run(fold: pa.Array, x: pa.Array) -> pa.Array:
        of, given = fold.to_numpy(), matrix_of(x)
        out = np.empty_like(given)
        for k in np.unique(of).tolist():
            at = np.flatnonzero(of == k)
            out[at] = _rows_through(shared.value[k], given[at])
        return list_of(out)

    through = lambda df: df.withColumn("x", run("fold", "x"))
    return Matrix(through(rows), m.folds, True, m, steps, through)


@dataclass
class Run:
    """What a run did with each node: computed, reused or failed; seconds of those computed; the estimators' numbers."""

    keys: dict[str, str]
    outcome: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, list[list]] = field(default_factory=dict)

    def nodes(self, outcome: str) -> list[str]:
        return [i for i, o in self.outcome.items() if o == outcome]

    def summary(self) -> dict[str, object]:
        return {o: len(self.nodes(o)) for o in ("computed", "reused", "failed")} | {"seconds": round(sum(self.seconds.values()), 3), "failed_node": next(iter(self.nodes("failed")), None)}

    def experiment(self, experiment_id: str, pipeline: str, version: str) -> tuple:
        """A row of ``catalog.EXPERIMENT`` but for its time: the last estimator's numbers, and whether all nodes are there."""
        last = next((m for _, m in reversed(self.metrics.items())), [])
        return experiment_id, pipeline, version, {f"{part}.{name}": value for part, name, value in last if value is not None and part != "coefficients"}, "failed" if self.nodes("failed") else "succeeded"


class Execution:
    """A pipeline bound to a version of a table and a store.

    The table has sample_idx (from 0), x, and any further columns, which go along
    to the estimators; of these ``fold`` and ``held`` are left behind.
    """

    def __init__(self, pipeline: Pipeline, source: DataFrame, version: str, store: Store, keep: str = "all", axis: np.ndarray | None = None):
        """keep: "all" stores every node's matrix, "shared" only those that several nodes or an estimator read, "splits" only those of splits; the others' parameters are stored and their rows derived again.  axis: the source's, for range_select."""
        if keep not in ("all", "shared", "splits"):
            raise Refused(f"matrices are kept all, shared or splits, not {keep}")
        self.pipeline, self.source, self.store, self.keep, self.axis = pipeline, source, store, keep, axis
        self.keys = {i: k.split(":")[1] for i, k in pipeline.keys(version).items()}
        self.order = sorted(pipeline.nodes, key=lambda n: len(pipeline.ancestors(n.id)))
        there = store.commits(set(self.keys.values()))
        self.known = {i: there[k] for i, k in self.keys.items() if k in there}
        self.ready: dict[str, Matrix] = {}

    def governing(self, id: str) -> Node | None:
        """The split that a node stands below or is."""
        return next((n for n in [self.pipeline.node(id), *self.pipeline.ancestors(id)] if n.kind in SPLITS), None)

    def _kept(self, node: Node) -> bool:
        readers = [n for n in self.pipeline.nodes if n.input == node.id]
        return self.keep == "all" or self.keep == "shared" and (len(readers) > 1 or any(n.kind in ESTIMATORS for n in readers))

    def matrix(self, id: str) -> Matrix:
        """A node's rows: stored, or through stored parameters, or computed now.  Nothing above a stored matrix is touched."""
        if id not in self.ready:
            node = self.pipeline.node(id)
            if node.kind == "source":
                self.ready[id] = Matrix(finite(self.source.drop("fold", "held")))
            elif node.kind in ESTIMATORS:
                raise Refused(f"node {id} is an estimator and has no matrix")
            else:
                record = self.known.get(id)
                if record is None:
                    self._compute(node)
                elif record.rows:
                    self.ready[id] = self._stored(id, record)
                else:
                    self.ready[id] = self._derived(node, record.steps)
        return self.ready[id]

    def _stored(self, id: str, record: Commit) -> Matrix:
        df = self.store.read(self.keys[id])
        return Matrix(df if record.versioned else df.drop("fold"), record.folds, record.versioned)

    def _derived(self, node: Node, steps: dict[int, dict] | None) -> Matrix:
        """Rows of a step or split from its input's."""
        above = self.matrix(node.input)
        if node.kind in SPLITS:
            held, by = routing.held(above.df, node.kind, dict(node.options))
            rows = above.df.join(held, by, "left")
            folds = [r["held"] for r in held.select("held").distinct().orderBy("held").limit(routing.MOST_FOLDS + 1).collect()]
            if len(folds) > routing.MOST_FOLDS:
                raise Refused(f"more than {routing.MOST_FOLDS} folds would each need a model")
            return Matrix(rows, folds)
        if steps:
            return _through(above, {k: pre.from_spec(s) for k, s in steps.items()})
        step = self._step(node)
        return Matrix(step.transform(above.df), above.folds, above.versioned)

    def _compute(self, node: Node) -> None:
        """A step or split: learned, stored if it is to be, committed."""
        above, record = self.matrix(node.input), Commit(node.kind)
        if node.kind not in SPLITS:
            step = self._step(node)
            if step.needs_fit:
                learned = _fitted(step, above) if above.folds is not None else {ALL: step.fit(above.df)}
                record.steps = {k: pre.to_spec(s) for k, s in learned.items()}
        out = self._derived(node, record.steps)
        record.folds = out.folds
        if self._kept(node) or node.kind in SPLITS:
            rows = out.df if out.versioned else out.df.drop("fold").withColumn("fold", F.lit(ALL))
            record.rows = self.store.write(self.keys[node.id], rows)
            out = self._stored(node.id, record)
        self.store.commit(self.keys[node.id], record)
        self.known[node.id], self.ready[node.id] = record, out

    def _estimate(self, node: Node) -> list[list]:
        above = self.matrix(node.input)
        found = estimators.RUNNERS[node.kind](above, dict(node.options))
        record = Commit(node.kind, above.folds)
        path = f"{self.store.path}/results/key={self.keys[node.id]}/{uuid.uuid4().hex}"
        found.rows.write.parquet(path)
        record.files["rows"] = path
        if found.model is not None:
            found.model.steps = self.chain(node.input)
            record.files["model"] = f"{self.store.path}/models/key={self.keys[node.id]}/{uuid.uuid4().hex}"
            found.model.save(self.store.spark, record.files["model"])
        record.metrics = found.numbers(self.store.spark.read.parquet(path))
        self.store.commit(self.keys[node.id], record)
        self.known[node.id] = record
        return record.metrics

    def _step(self, node: Node) -> pre.Step:
        """A step as declared; a range is looked up on the axis that selections above have left."""
        if node.kind != "range_select":
            return pre.from_spec({"kind": node.kind} | dict(node.options))
        axis = self.axis
        for n in reversed(self.pipeline.ancestors(node.id)):
            if n.kind in ("range_select", "select_variables") and axis is not None:
                axis = axis[sorted(set(self._step(n).indices))]
        if axis is None:
            raise Refused("a range needs the source's axis")
        return pre.range_select(axis, **dict(node.options))

    def chain(self, id: str) -> list[pre.Step]:
        """The steps above and with a node, as learned from all samples."""
        out = []
        for n in reversed([self.pipeline.node(id), *self.pipeline.ancestors(id)]):
            if n.kind != "source" and n.kind not in SPLITS:
                learned = self.known[n.id].steps if n.id in self.known else {}
                out.append(pre.from_spec(learned[ALL]) if learned else self._step(n))
        return out

    def run(self) -> Run:
        """Compute what isn't stored, in order; the first node that fails ends the run as NodeFailed with the run so far in ``run``."""
        out = Run(self.keys)
        for node in self.order:
            if node.kind == "source":
                continue
            if node.id in self.known:
                out.outcome[node.id] = "reused"
                if node.kind in ESTIMATORS:
                    out.metrics[node.id] = self.known[node.id].metrics
                continue
            began = time.perf_counter()
            try:
                if node.kind in ESTIMATORS:
                    out.metrics[node.id] = self._estimate(node)
                else:
                    self._compute(node)
                out.outcome[node.id] = "computed"
            except (Refused, PySparkException) as why:
                out.outcome[node.id] = "failed"
                failed = NodeFailed(node.id, why)
                failed.run = out
                raise failed from why
            finally:
                out.seconds[node.id] = time.perf_counter() - began
        return out

    def results(self, id: str) -> DataFrame:
        """An estimator's per-sample rows, of ``part`` calibration or cross_validation."""
        if id not in self.known or "rows" not in self.known[id].files:
            raise Refused(f"node {id} has no stored result")
        return self.store.spark.read.parquet(self.known[id].files["rows"])

