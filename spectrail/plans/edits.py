"""Changes of a declared pipeline: each gives a new pipeline, or is refused with the reason; what can be declared, as a schema."""

from __future__ import annotations

import dataclasses
import types
import typing

from spectrail.functions.arrays import Refused
from spectrail.operators.preprocess import STEPS

from . import estimators, routing
from .pipeline import ESTIMATORS, SPLITS, Node, Pipeline

#: Models whose samples are diagnosed on their own components, and those diagnosed class by class.
DIAGNOSED, DIAGNOSED_BY_CLASS = frozenset({"pca", "pls", "pcr"}), frozenset({"plsda", "lda", "knn", "svm"})


def diagnosed(kind: str) -> str | None:
    """whole, by class, or None for a model that isn't diagnosed."""
    return "whole" if kind in DIAGNOSED else "by class" if kind in DIAGNOSED_BY_CLASS else None


def not_run(pipeline: Pipeline) -> list[tuple[str, str]]:
    """(node, why) of the nodes that can be declared and have nothing that runs them; said before a run, not after."""
    return [(n.id, f"nothing runs {n.kind}") for n in pipeline.nodes if n.kind in ESTIMATORS - estimators.RUNNERS.keys() or n.kind in SPLITS & routing.DECLARED_ONLY]


def _with(pipeline: Pipeline, changed: dict[str, Node | None], more: tuple[Node, ...] = ()) -> Pipeline:
    """The nodes with some replaced or left out, and more behind them; all checks of a pipeline hold for the result."""
    kept = [changed.get(n.id, n) for n in pipeline.nodes]
    return Pipeline((*[n for n in kept if n is not None], *more))


def _known(pipeline: Pipeline, id: str) -> Node:
    found = next((n for n in pipeline.nodes if n.id == id), None)
    if found is None:
        raise Refused(f"node {id} isn't in this pipeline")
    return found


def connected(pipeline: Pipeline, above: str, below: str) -> Pipeline:
    """``below`` takes its rows from ``above``, in place of what it took them from."""
    source, node = _known(pipeline, above), _known(pipeline, below)
    if node.kind == "source":
        raise Refused(f"node {below} is the source and takes no input")
    if above == below or any(n.id == above for n in pipeline.descendants(below)):
        raise Refused(f"node {above} stands at or below {below}: they would make a cycle")
    if node.input == above:
        raise Refused(f"node {below} already takes its rows from {above}")
    if source.kind in ESTIMATORS:
        raise Refused(f"node {above} is an estimator, nothing stands below it")
    return _with(pipeline, {below: dataclasses.replace(node, input=above)})


def removed(pipeline: Pipeline, id: str) -> Pipeline:
    """Without a node; those that took their rows from it take them from its own input."""
    node = _known(pipeline, id)
    if node.kind == "source":
        raise Refused(f"node {id} is the source and can't be removed")
    return _with(pipeline, {id: None} | {n.id: dataclasses.replace(n, input=node.input) for n in pipeline.nodes if n.input == id})


def _free(pipeline: Pipeline, stem: str, taken: set[str] = frozenset()) -> str:
    used = {n.id for n in pipeline.nodes} | set(taken)
    return next(name for name in [stem, *(f"{stem} {k}" for k in range(2, len(used) + 3))] if name not in used)


def added(pipeline: Pipeline, above: str, kind: str, **options) -> Pipeline:
    """With a node below ``above``, named by its kind, with a number if that name is taken."""
    _known(pipeline, above)
    return _with(pipeline, {}, (Node.of(_free(pipeline, kind), kind, above, **options),))


def duplicated(pipeline: Pipeline, id: str) -> Pipeline:
    """With a copy of a node and all that stands below it, beside the node."""
    node = _known(pipeline, id)
    if node.kind == "source":
        raise Refused(f"node {id} is the source; a pipeline has one")
    copies, names = [], {}
    for n in [node, *sorted(pipeline.descendants(id), key=lambda n: len(pipeline.ancestors(n.id)))]:
        names[n.id] = _free(pipeline, n.id, set(names.values()))
        copies.append(dataclasses.replace(n, id=names[n.id], input=names.get(n.input, n.input)))
    return _with(pipeline, {}, tuple(copies))


def _type(hint) -> dict:
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        return _type(next(a for a in typing.get_args(hint) if a is not type(None)))
    if typing.get_origin(hint) is tuple:
        return {"type": "array", "items": _type(typing.get_args(hint)[0])}
    return {"type": {int: "integer", float: "number", bool: "boolean", str: "string"}.get(hint, "array")}


#: What a fit fills in, and where a step finds its rows: not declared.
_FITTED = {"mean", "scale", "spectrum", "x"}


def schema() -> dict[str, dict]:
    """For each kind of node the properties that may be declared, their types and defaults, and those that must be."""
    out: dict[str, dict] = {"source": {"properties": {}, "required": []}}
    for kind, step in STEPS.items():
        hints = typing.get_type_hints(step)
        fields = [f for f in dataclasses.fields(step) if f.name not in _FITTED]
        out[kind] = {"properties": {f.name: _type(hints[f.name]) | ({"default": f.default} if f.default is not dataclasses.MISSING else {}) for f in fields}, "required": []}
    out["range_select"] = {"properties": {"start": {"type": "number"}, "end": {"type": "number"}}, "required": ["start", "end"]}
    for kinds in (routing.OPTIONS, estimators.OPTIONS):
        for kind, options in kinds.items():
            out[kind] = {
                "properties": {k: (_type(type(v)) | {"default": v}) if v is not None else {"type": "string" if k in ("target", "class_column", "group_by", "stratify_by") else "integer"} for k, v in options.items()},
                "required": [k for k, v in options.items() if v is None and k not in ("group_by", "stratify_by")],
            }
    return out
