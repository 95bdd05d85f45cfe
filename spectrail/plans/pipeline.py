"""Declared pipelines: a forest of steps, splits and estimators with checks, recipe keys and differences."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from spectrail.functions.arrays import Refused
from spectrail.operators.preprocess import STEPS, from_spec

SPLITS = {"kfold", "loo", "train_test", "repeated_kfold", "external"}
ESTIMATORS = {"pca", "pls", "pcr", "ridge", "elastic_net", "mlr", "opls", "oplsda", "svr", "svm", "plsda", "simca", "lda", "qda", "knn", "logistic"}
#: Steps that learn from the samples, and linear models, which take centred variables (components centre by themselves).
FITTED = {"mean_centre", "autoscale", "msc"}
CENTRED = {"pls", "pcr", "ridge", "elastic_net", "mlr", "opls", "plsda", "oplsda"}


@dataclass(frozen=True)
class Node:
    """kind is source, a step, a split or an estimator; input names the node before it."""

    id: str
    kind: str
    input: str | None = None
    options: tuple[tuple[str, object], ...] = ()

    @classmethod
    def of(cls, id: str, kind: str, input: str | None = None, **options) -> Node:
        return cls(id, kind, input, tuple(sorted(options.items())))


@dataclass(frozen=True)
class Pipeline:
    nodes: tuple[Node, ...]

    def __post_init__(self):
        known: dict[str, Node] = {}
        for n in self.nodes:
            if n.id in known:
                raise Refused(f"node {n.id} occurs twice")
            known[n.id] = n
        if sum(n.kind == "source" for n in self.nodes) != 1:
            raise Refused("a pipeline has one source")
        for n in self.nodes:
            if n.kind != "source" and n.input not in known:
                raise Refused(f"node {n.id}: its input {n.input} isn't known")
            if n.kind != "source" and n.kind not in STEPS.keys() | SPLITS | ESTIMATORS | {"range_select"}:
                raise Refused(f"node {n.id}: kind {n.kind} isn't known")
            if n.kind in STEPS:
                from_spec({"kind": n.kind} | dict(n.options))
        for n in self.nodes:
            above = self.ancestors(n.id)
            if any(a.kind in ESTIMATORS for a in above):
                raise Refused(f"node {n.id} stands below an estimator")
            if n.kind in SPLITS and any(a.kind in SPLITS for a in above):
                raise Refused(f"node {n.id}: a split below a split")

    def node(self, id: str) -> Node:
        return next(n for n in self.nodes if n.id == id)

    def ancestors(self, id: str) -> list[Node]:
        """From the input up to the source."""
        out, seen, n = [], {id}, self.node(id)
        while n.input is not None:
            if n.input in seen:
                raise Refused(f"node {id} stands in a cycle")
            seen.add(n.input)
            n = self.node(n.input)
            out.append(n)
        return out

    def descendants(self, id: str) -> list[Node]:
        return [n for n in self.nodes if id in {a.id for a in self.ancestors(n.id)}]

    def keys(self, version: str) -> dict[str, str]:
        """Each node's recipe key: of its own declaration, what stands above it, and the data's version."""
        made: dict[str, str] = {}
        for n in sorted(self.nodes, key=lambda n: len(self.ancestors(n.id))):
            body = json.dumps([n.kind, dict(n.options), made[n.input] if n.input else version], sort_keys=True)
            made[n.id] = "sha256:" + hashlib.sha256(body.encode()).hexdigest()
        return made

    def warnings(self) -> list[tuple[str, str]]:
        """(node, what): statistics learnt above a split, linear models without centring, selections made on what is validated."""
        out = []
        for n in self.nodes:
            above = self.ancestors(n.id)
            if n.kind in SPLITS:
                out += [(a.id, f"is fitted above the split {n.id} and so sees held-out samples") for a in above if a.kind in FITTED]
                out += [(a.id, f"was chosen on the samples that {n.id} validates") for a in above if a.kind == "select_variables" and dict(a.options).get("chosen_by")]
            if n.kind in CENTRED and not any(a.kind in ("mean_centre", "autoscale") for a in above):
                out.append((n.id, "is fitted on variables that aren't centred"))
        return out

    def state(self, version: str, stored: set[str]) -> dict[str, str]:
        """current if a node's key is stored, else stale."""
        return {i: "current" if k in stored else "stale" for i, k in self.keys(version).items()}


def difference(a: Pipeline, b: Pipeline) -> dict[str, str]:
    """added, removed, changed or unchanged, by node."""
    left, right = {n.id: n for n in a.nodes}, {n.id: n for n in b.nodes}
    return {i: "added" if i not in left else "removed" if i not in right else "unchanged" if left[i] == right[i] else "changed" for i in sorted(left | right)}
