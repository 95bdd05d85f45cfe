"""Edits of pipelines, the schema of what can be declared, and what says that nothing runs a node."""

import pytest

from spectrail.functions.arrays import Refused
from spectrail.functions.quantiles import spe_caveat
from spectrail.plans import edits
from spectrail.plans.pipeline import Node, Pipeline

CHAIN = Pipeline((Node.of("source", "source"), Node.of("snv", "snv", "source"), Node.of("centre", "mean_centre", "snv"), Node.of("pca", "pca", "centre", n_components=2), Node.of("msc", "msc", "source")))


def inputs(p):
    return {n.id: n.input for n in p.nodes}


def test_edits():
    assert inputs(edits.connected(CHAIN, "msc", "centre"))["centre"] == "msc"
    assert inputs(edits.removed(CHAIN, "snv")) == {"source": None, "centre": "source", "pca": "centre", "msc": "source"}
    more = edits.added(CHAIN, "msc", "snv")
    assert inputs(more)["snv 2"] == "msc" and inputs(edits.added(more, "msc", "snv"))["snv 3"] == "msc"
    twice = edits.duplicated(CHAIN, "snv")
    assert inputs(twice) == inputs(CHAIN) | {"snv 2": "source", "centre 2": "snv 2", "pca 2": "centre 2"} and dict(twice.node("pca 2").options) == {"n_components": 2}


@pytest.mark.parametrize("change,why", [
    (lambda: edits.connected(CHAIN, "pca", "msc"), "estimator"), (lambda: edits.connected(CHAIN, "centre", "snv"), "cycle"), (lambda: edits.connected(CHAIN, "snv", "snv"), "cycle"), (lambda: edits.connected(CHAIN, "snv", "source"), "takes no input"),
    (lambda: edits.connected(CHAIN, "snv", "centre"), "already"), (lambda: edits.connected(CHAIN, "none", "snv"), "isn't in"), (lambda: edits.removed(CHAIN, "source"), "can't be removed"), (lambda: edits.duplicated(CHAIN, "source"), "has one"),
    (lambda: edits.added(CHAIN, "pca", "snv"), "below an estimator"), (lambda: edits.added(CHAIN, "snv", "savgol", window_length=4), "odd"),
])
def test_edits_that_are_refused(change, why):
    with pytest.raises(Refused, match=why):
        change()


def test_schema_and_what_runs():
    known = edits.schema()
    assert known["savgol"]["properties"]["window_length"] == {"type": "integer", "default": 11} and "mean" not in known["autoscale"]["properties"]
    assert known["select_variables"]["properties"]["indices"] == {"type": "array", "items": {"type": "integer"}, "default": ()}
    assert known["pls"]["required"] == ["target", "n_components"] and known["kfold"]["properties"]["shuffle"] == {"type": "boolean", "default": True}
    assert edits.not_run(CHAIN) == [] and edits.not_run(Pipeline((Node.of("source", "source"), Node.of("again", "repeated_kfold", "source")))) == [("again", "nothing runs repeated_kfold")]
    assert [edits.diagnosed(k) for k in ("pca", "svm", "simca")] == ["whole", "by class", None]


def test_caveat_of_the_residual_limit():
    assert spe_caveat([5.0, 1.0, 0.9, 0.8], 1) is None
    assert "not above zero" in spe_caveat([5.0, 1.0] + [0.03] * 60, 1)
