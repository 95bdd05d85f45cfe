"""Cross-validated curves, searches and nested selection against fits on the rows themselves."""

import numpy as np
import pytest

from spectrail.functions.arrays import Refused
from spectrail.operators import crossval, kernels, regression, roles, selection, splits
from spectrail.plans import results
from spectrail.sources import delimited


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8)) + 2
    return x, x[:, 2] - 2 * x[:, 5] + 0.3 * rng.normal(size=60), np.arange(60) % 4


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold = data
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(60)], "sample_idx bigint, x array<double>, y double, fold int").repartition(3).cache()


def errors_by_hand(data, fit, columns=None):
    """Pooled error of each row of coefficients, from the rows."""
    x, y, fold = data
    x = x if columns is None else x[:, columns]
    sse = 0.0
    for k in sorted(set(fold)):
        a, b = x[fold != k], y[fold != k]
        e = y[fold == k][:, None] - (x[fold == k] - a.mean(0)) @ fit(a - a.mean(0), b - b.mean()).T - b.mean()
        sse = sse + (e * e).sum(0)
    return np.sqrt(sse / len(y))


def components(a):
    return lambda x, y: np.stack([kernels.pls(x, y, k).coefficients() for k in range(1, a + 1)])


def by_scores(x, y):
    v = np.linalg.svd(x, full_matrices=False)[2]
    return np.stack([v[:a].T @ np.linalg.lstsq(x @ v[:a].T, y, rcond=None)[0] for a in range(1, 5)])


def penalised(x, y):
    return np.stack([np.linalg.solve(x.T @ x + a * np.eye(8), x.T @ y) for a in (0.1, 10.0, 1000.0)])


def net(x, y):
    """Elastic net by proximal gradient descent."""
    out = []
    for alpha in (0.5, 0.05):
        b, n = np.zeros(8), len(y)
        rate = 1 / (np.linalg.norm(x, 2) ** 2 / n + alpha / 2)
        for _ in range(20_000):
            b = b - rate * (x.T @ (x @ b - y) / n + alpha / 2 * b)
            b = np.sign(b) * np.maximum(np.abs(b) - rate * alpha / 2, 0)
        out.append(b)
    return np.stack(out)


@pytest.mark.parametrize(
    ("fit", "by_hand"),
    [
        (regression.pls_path(4), components(4)),
        (regression.opls_path(3), components(4)),
        (regression.pcr_path(4), by_scores),
        (regression.ridge_path([0.1, 10.0, 1000.0]), penalised),
        (regression.elastic_net_path([0.5, 0.05]), net),
        (regression.mlr_fit, lambda x, y: np.linalg.lstsq(x, y, rcond=None)[0][None]),
    ],
)
def test_curves(table, data, fit, by_hand):
    got = [r.rmsecv for r in regression.rmsecv_curve(table, "y", fit).orderBy("a").collect()]
    assert np.allclose(got, errors_by_hand(data, by_hand), rtol=1e-6)


def test_searches(table, data):
    errors = selection.FoldErrors(table, "y")
    for columns in ([2, 5], [0, 1, 2], list(range(8))):
        assert np.allclose(errors.rmsecv(np.array(columns), 2), errors_by_hand(data, components(2), columns))
    found, chosen, path = selection.ipls(errors, 4, 2)
    bounds = [(0, 2), (2, 4), (4, 6), (6, 8)]
    each = [errors_by_hand(data, components(2), list(range(*b))) for b in bounds]
    assert [(f.start, f.end) for f in found] == bounds and np.allclose([f.rmsecv for f in found], [e.min() for e in each]) and [f.components for f in found] == [int(e.argmin()) + 1 for e in each]
    left, best, order = set(range(4)), np.inf, []
    while left:
        tried = {j: errors_by_hand(data, components(2), [c for i in sorted([*order, j]) for c in range(*bounds[i])]).min() for j in left}
        j = min(tried, key=lambda i: (tried[i], i))
        if tried[j] >= best:
            break
        best = tried[j]
        order.append(j)
        left.discard(j)
    assert chosen == order and np.isclose(path[-1], best)
    columns, error = selection.cars(table, errors, "y", 3, runs=20)
    assert np.isclose(error, errors_by_hand(data, components(min(3, len(columns))), columns).min()) and error <= errors_by_hand(data, components(3)).min() * 1.2
    assert selection.by_threshold(np.array([0.5, 1.0, -2.0])) == [1, 2]


def test_nested(table, data):
    x, y, fold = data
    pick = lambda e: np.array(min(([0, 1, 2], [2, 5], [6, 7]), key=lambda c: float(e.rmsecv(np.array(c), 2).min())))
    sse = 0.0
    for k in range(4):
        a, b, idx = x[fold != k], y[fold != k], np.arange(60)[fold != k]
        inner = lambda c, a=a, b=b, idx=idx: errors_by_hand((a, b, idx % 5), components(2), c).min()
        c = min(([0, 1, 2], [2, 5], [6, 7]), key=inner)
        w = kernels.pls(a[:, c] - a[:, c].mean(0), b - b.mean(), 2).coefficients()
        e = y[fold == k] - (x[fold == k][:, c] - a[:, c].mean(0)) @ w - b.mean()
        sse += e @ e
    assert np.isclose(selection.nested(table, "y", 2, pick), np.sqrt(sse / 60))


def test_repeated_folds(table):
    rows = splits.repeated_k_fold(table, 5, 3, seed=1).collect()
    assert sorted({r.fold for r in rows}) == list(range(15)) and all(sorted(r.sample_idx for r in rows if r.fold // 5 == k) == list(range(60)) for k in range(3))
    with pytest.raises(Refused):
        splits.k_fold(table, 5, order="other")


def test_results(table, data):
    x, y, fold = data
    got = {(r.part, r.metric): r.value for r in results.regression_result(table, "y", regression.pls_path(3), 1).collect()}
    curve = errors_by_hand(data, components(3))
    assert np.allclose([got["cross_validation", f"rmsecv_a{k}"] for k in (1, 2, 3)], curve) and np.isclose(got["cross_validation", "rmsecv"], curve[1])
    e = y - y.mean() - (x - x.mean(0)) @ kernels.pls(x - x.mean(0), y - y.mean(), 2).coefficients()
    assert np.isclose(got["calibration", "rmsec"], np.sqrt((e * e).mean())) and np.isclose(got["calibration", "sec"], np.sqrt(((e - e.mean()) ** 2).sum() / 57))
    assert np.isclose(got["cross_validation", "q2"], 1 - curve[1] ** 2 / y.var()) and sum(m.startswith("rmsecv_fold_") for _, m in got) == 4
    assert np.isclose(got["cross_validation", "rmsecv_std"], np.std([got["cross_validation", f"rmsecv_fold_{k}"] for k in range(4)], ddof=1))
    alpha, error = zip(*[(r.alpha, r.rmsecv) for r in results.tuning_result(table, "y", "ridge", 5).orderBy("alpha").collect()])
    want = lambda u, v: np.stack([np.linalg.solve(u.T @ u + a * np.eye(8), u.T @ v) for a in alpha])
    assert np.isclose(alpha[-1], np.linalg.norm(x - x.mean(0), 2) ** 2) and np.allclose(error, errors_by_hand(data, want))
    assert len(results.tuning_result(table, "y", "elastic_net", 4).collect()) == 4


def test_classifier_result(spark, data):
    x, y, fold = data
    df = spark.createDataFrame([(i, x[i].tolist(), "ab"[int(y[i] > np.median(y))], int(fold[i])) for i in range(60)], "sample_idx bigint, x array<double>, label string, fold int")
    held = {r.sample_idx: (r.observed, r.predicted) for r in crossval.cross_validated(df, "label", crossval.discriminant(3)).collect()}
    got = {(r.part, r.metric): r.value for r in results.classifier_result(df, "label", crossval.discriminant(3)).collect()}
    assert np.isclose(got["cross_validation", "accuracy"], np.mean([o == p for o, p in held.values()]))
    assert np.isclose(got["class a", "sensitivity"], np.mean([p == "a" for o, p in held.values() if o == "a"]))


def test_selectors(table, data):
    x, y, _ = data
    errors = selection.FoldErrors(table, "y")
    m = kernels.pls(x - x.mean(0), y - y.mean(), 3)
    assert selection.vip_selector(3)(errors).tolist() == np.flatnonzero(m.vip() >= 1).tolist()
    assert selection.coefficient_selector(3, 0.1)(errors).tolist() == np.flatnonzero(np.abs(m.coefficients()) >= 0.1).tolist()
    chosen = selection.ipls(errors, 4, 2)[1]
    assert selection.ipls_selector(4, 2)(errors).tolist() == [c for i in sorted(chosen) for c in (2 * i, 2 * i + 1)]
    assert selection.cars_selector(3, 15)(errors).tolist() == selection.cars(table, errors, "y", 3, 15)[0]


def test_roles(spark):
    df = spark.createDataFrame([(0, "s0", 1.0, "5.5", "a"), (1, "s1", 2.5, "6", "a")], "sample_idx bigint, sample_id string, t_fat double, m_water string, m_kind string")
    got = roles.change_roles(df, {"fat": "class", "water": "target"})
    assert roles.roles_of(got) == {"fat": "class", "water": "target", "kind": "metadata"} and sorted((r.c_fat, r.t_water) for r in got.collect()) == [("1", 5.5), ("2.5", 6.0)]
    assert "m_kind" not in roles.change_roles(df, {"kind": "ignore"}).columns
    for bad, what in (({"kind": "class"}, "one value"), ({"none": "class"}, "no column"), ({"kind": "metadata"}, "already"), ({"kind": "x"}, "no role")):
        with pytest.raises(Refused, match=what):
            roles.change_roles(df, bad)
    with pytest.raises(Exception, match="column kind, sample s"):
        roles.change_roles(df, {"kind": "target"}).collect()


def test_preview(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;1000;1010;fat\ns1;0,1;0,2;3\ns2;0,3;0,4;5\n")
    layout, cells = delimited.preview(spark, str(tmp_path / "a.csv"), 2)
    assert layout.delimiter == ";" and layout.decimal_comma and cells == [["id", "1000", "1010", "fat"], ["s1", "0,1", "0,2", "3"]]
