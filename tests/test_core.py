"""The steps, splits and models against NumPy, and refusals."""

import numpy as np
import pytest

from spectrail.functions.arrays import Refused, finite
from spectrail.operators import classification, decomposition, kernels, neighbours, outliers, regression, selection, splits
from spectrail.operators import preprocess as pre
from spectrail.operators.factors import training_sets


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 9)) @ rng.normal(size=(9, 9)) + 3
    return x, x @ rng.normal(size=9) + 0.1 * rng.normal(size=40)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    return spark.createDataFrame([(i, r.tolist(), float(v), "abc"[i % 3], i % 4) for i, (r, v) in enumerate(zip(x, y))], "sample_idx bigint, x array<double>, y double, label string, fold int").cache()


def matrix(df):
    return np.array([r.x for r in df.orderBy("sample_idx").collect()])


def test_steps_match_numpy(table, data):
    x, _ = data
    assert np.allclose(matrix(pre.Snv().transform(table)), (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True), atol=1e-12)
    assert np.allclose(matrix(pre.Autoscale().fit_transform(table)), (x - x.mean(0)) / x.std(0, ddof=1), atol=1e-12)
    r = np.median(x, axis=0)
    b = ((x - x.mean(1, keepdims=True)) @ (r - r.mean())) / ((r - r.mean()) @ (r - r.mean()))
    assert np.allclose(matrix(pre.Msc(reference="median").fit_transform(table)), (x - (x.mean(1) - b * r.mean())[:, None]) / b[:, None], atol=1e-10)


def test_smoothers_keep_straight_lines(spark):
    line = spark.createDataFrame([(0, [2.0 * k + 1 for k in range(15)])], "sample_idx bigint, x array<double>")
    for step in (pre.SavGol(7, 2), pre.Whittaker(50.0)):
        assert np.allclose(matrix(step.transform(line)), matrix(line), atol=1e-8)
    assert np.allclose(matrix(pre.Baseline("polynomial", order=1).transform(line)), 0, atol=1e-9)
    assert np.allclose(matrix(pre.SavGol(5, 2, 1).transform(line)), 2)


def test_affine_chain_folds(table, data):
    steps = [pre.SavGol(5, 2), pre.Autoscale(), pre.SelectVariables((1, 4, 7))]
    df = table
    for s in steps:
        df = s.fit_transform(df)
    m, c = pre.fused(steps, 9)
    assert np.allclose(matrix(df), data[0] @ m + c, atol=1e-10)
    with pytest.raises(Refused):
        pre.fused([pre.Snv()], 9)


def test_refusals(spark, table):
    flat = spark.createDataFrame([(0, [1.0, 1.0, 1.0])], "sample_idx bigint, x array<double>")
    for broken in (pre.Snv().transform(flat), finite(spark.createDataFrame([(7, [1.0, float("nan")])], "sample_idx bigint, x array<double>"))):
        with pytest.raises(Exception, match="zero scale|sample 7"):
            broken.collect()
    for bad in ({"kind": "nothing"}, {"kind": "savgol", "window_length": 4}, {"kind": "snv", "ddof": 2}):
        with pytest.raises(Refused):
            pre.from_spec(bad)
    with pytest.raises(Refused):
        pre.range_select(np.arange(5.0), 8, 9)
    with pytest.raises(Refused):
        splits.k_fold(table, 100)
    with pytest.raises(Refused):
        outliers.exclude(table, [])


def test_folds(table, spark):
    rows = splits.k_fold(table.limit(10), 3, seed=42).orderBy("fold", "sample_idx").collect()
    order = np.random.default_rng(42).permutation(10)
    assert [sorted(r.sample_idx for r in rows if r.fold == k) for k in range(3)] == [sorted(order[:4]), sorted(order[4:7]), sorted(order[7:])]
    for folds in (splits.k_fold(table, 7), splits.stratified_k_fold(table, "label", 4), splits.stratified_k_fold(table, "label", 4, seed=1), splits.by_group(table, "label", splits.leave_one_out), splits.leave_one_out(table)):
        splits.validate_partition(table, folds)
    with pytest.raises(Refused):
        splits.validate_partition(table, splits.train_test(table))


def test_fold_factors_equal_direct_fits(table, data):
    x, y = data
    whole, folds = training_sets(table, ["y"])
    assert whole.n == 40 and np.allclose(whole.x_mean, x.mean(0))
    got = {r.sample_idx: r.yhat for r in regression.cross_validated(table, "y", regression.pls_path(3)).collect()}
    for k in range(4):
        train = np.arange(40) % 4 != k
        xm, ym = x[train].mean(0), y[train].mean()
        b = kernels.pls(x[train] - xm, y[train] - ym, 3).coefficients()
        assert np.allclose([got[i][2] for i in np.flatnonzero(~train)], (x[~train] - xm) @ b + ym, atol=1e-8)
    assert np.isclose(np.sum(kernels.pls(whole.x, whole.y[:, 0], 3, whole.n).vip() ** 2), 9)


def test_linear_models(data):
    x, y = data[0] - data[0].mean(0), data[1] - data[1].mean()
    assert np.allclose(kernels.ridge(x, y, 2.0)[0], np.linalg.solve(x.T @ x + 2 * np.eye(9), x.T @ y))
    assert np.allclose(kernels.mlr(x, y), np.linalg.lstsq(x, y, rcond=None)[0])
    b = kernels.elastic_net(x.T @ x, x.T @ y, 40, 0.2, 0.5)
    grad = x.T @ (x @ b - y) / 40 + 0.1 * b
    assert np.all(np.where(b != 0, np.abs(grad + 0.1 * np.sign(b)) < 1e-6, np.abs(grad) <= 0.1 + 1e-9))
    with pytest.raises(Refused):
        kernels.mlr(np.column_stack([x, x[:, 0]]), y)
    assert np.allclose(kernels.opls(x, y, 2)[0], kernels.pls(x, y, 3).coefficients())


def test_components(table, data):
    model, mean = decomposition.fit_pca(table, 2)
    x = data[0] - data[0].mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.eigenvalues, s**2 / 39)
    rows = decomposition.with_scores(table, model, mean).orderBy("sample_idx").collect()
    t = x @ model.loadings
    assert np.allclose([r.t2 for r in rows], (t**2 / model.eigenvalues[:2]).sum(1)) and np.allclose([r.spe for r in rows], ((x - t @ model.loadings.T) ** 2).sum(1), atol=1e-8)
    parts = decomposition.contributions(table, model, mean).groupBy("sample_idx").sum("t2_part").orderBy("sample_idx").collect()
    assert np.allclose([p[1] for p in parts], [r.t2 for r in rows])
    top = decomposition.limits(model)
    assert 0 < top["t2"] < 40 and top["spe"] > 0


def test_smo_meets_its_conditions(data):
    x = data[0] - data[0].mean(0)
    sign = np.where(data[1] > np.median(data[1]), 1.0, -1.0)
    k = kernels.kernel(x, x, "rbf", 0.05)
    a, rho = kernels.smo(k, sign, -np.ones(40), 1.0)
    margin = sign * (k @ (a * sign) - rho)
    assert abs(a @ sign) < 1e-9 and np.all(margin[a < 1e-9] > 0.99) and np.all(margin[a > 1 - 1e-9] < 1.01)


def test_classifiers(table):
    for got in (classification.pls_da(table, "label", 2), classification.discriminant(table, "label", 2), classification.svm(table, "label", 2), neighbours.knn(table, table, "label", 1)):
        assert got.count() == 40
    assert neighbours.knn(table, table, "label", 1).where("observed <> predicted").count() == 0
    assert classification.simca_table(classification.simca(table, "label", 1)).count() == 12
    with pytest.raises(Refused):
        classification.classes_of(table.where("label = 'a'"), "label")


def test_searches(table):
    errors = selection.FoldErrors(table, "y")
    curve = {r.a: r.rmsecv for r in regression.rmsecv_curve(table, "y", regression.pls_path(3)).collect()}
    assert np.allclose(errors.rmsecv(np.arange(9), 3), [curve[a] for a in (1, 2, 3)])
    assert selection.interval_bounds(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    found, chosen, path = selection.ipls(errors, 3, 2)
    assert len(found) == 3 and path == sorted(path, reverse=True) and len(chosen) == len(path)
    error, null, p = selection.permutation_test(table, "y", 2, 9)
    assert p == 0.1 and min(null) > error


def test_exclusion_numbers_anew(table):
    left = outliers.exclude(table, [0, 5]).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in left] == list(range(38)) and left[0].x == table.where("sample_idx = 1").first().x


def test_class_diagnostics(table):
    rows = outliers.by_class(table, "label", 2).collect()
    assert len(rows) == 40 and all(np.isclose(sum(r.leverage for r in rows if r.label == c), 3) for c in "abc")
    with pytest.raises(Refused):
        outliers.by_class(table.where("sample_idx < 5"), "label", 2)


def test_class_diagnostics_sees_every_variable(spark, tmp_path):
    from spectrail.plans import registry

    x = np.random.default_rng(3).normal(size=(80, 64))
    x[5, 40] += 50
    rows = [(k, k % 2, [float(v) for v in r]) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.sample_idx: r[2:] for r in registry.class_diagnostics(spark, str(tmp_path)).collect()}
    assert any(got[5][k] > 2 * max(r[k] for s, r in got.items() if s != 5) for k in range(len(got[5])) if isinstance(got[5][k], float))


def test_permutation_test_has_a_hundred_draws(spark):
    from spectrail.plans import registry

    p = registry.permutation_test(spark, "/root/testdata/sf0.001").first().p
    assert abs(p * 101 - round(p * 101)) < 1e-3
