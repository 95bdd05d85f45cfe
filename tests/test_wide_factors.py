"""Packed factors, merge trees by width, and fits of wide tables in tasks."""

import numpy as np
import pytest

from spectrail.functions.arrays import Refused
from spectrail.operators import factors, regression

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("shape", [(0, 4), (1, 4), (3, 4), (4, 4), (9, 4), (5, 1)])
def test_packing(shape):
    r = np.linalg.qr(RNG.normal(size=shape), mode="r")
    body = factors.packed(r)
    assert np.array_equal(factors.unpacked(body, shape[1]), r)
    assert len(body) == 8 * sum(shape[1] - i for i in range(min(shape)))


def test_levels_bound_what_a_task_stacks():
    assert factors.levels_for(65) == (32,)
    for width in (1000, 2001, 4002, 20_000):
        held, one = factors.PARTITIONS, 4 * width * (width + 1)
        for groups in (*factors.levels_for(width), 1):
            assert -(-held // groups) * one <= max(factors.TASK_BYTES, 2 * one) + one
            held = groups


def test_wide_tables_are_fitted_in_tasks(spark, monkeypatch):
    n, p = 90, 40
    x = RNG.normal(size=(n, 6)) @ RNG.normal(size=(6, p)) + 0.1 * RNG.normal(size=(n, p)) + 2
    y = x @ RNG.normal(size=p)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 4) for i in range(n)], "sample_idx bigint, x array<double>, y double, fold int").repartition(6)
    want = {r.sample_idx: r.yhat for r in regression.cross_validated(df, "y", regression.pls_path(3)).collect()}
    monkeypatch.setattr(factors, "WIDE", 10)
    monkeypatch.setattr(factors, "TASK_BYTES", 4 * 42 * 43 * 3)
    assert len(factors.levels_for(42)) > 3
    monkeypatch.setattr(factors, "training_sets", None)  # the driver isn't to see a factor
    got = {r.sample_idx: r.yhat for r in regression.cross_validated(df, "y", regression.pls_path(3)).collect()}
    assert len(got) == n and all(np.allclose(got[i], want[i], atol=1e-8) for i in range(n))
    fits = factors.fold_fits(df, ["y"], regression.mlr_fit if n > p + 40 else regression.ridge_path([1.0, 2.0]))
    assert set(fits) == {0, 1, 2, 3} and np.allclose(fits[1][1], x[np.arange(n) % 4 != 1].mean(0))
    with pytest.raises(Refused):
        regression.cross_validated(df.where("fold = 1"), "y", regression.pls_path(2))
