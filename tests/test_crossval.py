"""Cross-validated classifiers, diagnostics of PLS and resampling against NumPy on the rows themselves."""

import numpy as np
import pytest

from spectrail.functions.arrays import Refused
from spectrail.operators import classification, crossval, decomposition, kernel_machines, kernels, order, outliers, regression, selection, splits
from spectrail.operators.factors import factor, fold_factors


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    of = np.arange(90) % 3
    x = rng.normal(size=(90, 7)) @ rng.normal(size=(7, 7)) + np.array([[0] * 7, [1.5] * 3 + [0] * 4, [0] * 4 + [2] * 3])[of] + 5
    return x, of, np.arange(90) // 3 % 5, x @ rng.normal(size=7) + 0.3 * rng.normal(size=90)


@pytest.fixture(scope="module")
def table(spark, data):
    x, of, fold, y = data
    return spark.createDataFrame([(i, x[i].tolist(), "abc"[of[i]], int(fold[i]), float(y[i])) for i in range(90)], "sample_idx bigint, x array<double>, label string, fold int, y double").repartition(5).cache()


def predicted(df):
    return {r.sample_idx: r.predicted for r in df.collect()}


def by_hand(data, model):
    """predicted of each row by model(training rows, their classes, held-out rows)."""
    x, of, fold, _ = data
    out = {}
    for k in range(5):
        out |= dict(zip(np.flatnonzero(fold == k).tolist(), ("abc"[c] for c in model(x[fold != k], of[fold != k], x[fold == k]))))
    return out


def front(x, a):
    m = x.mean(0)
    return m, np.linalg.svd(x - m, full_matrices=False)[2][:a].T


def test_pls_da(table, data):
    def model(x, of, new):
        y = np.eye(3)[of]
        b = kernels.pls(x - x.mean(0), y - y.mean(0), 3).coefficients()
        return np.argmax((new - x.mean(0)) @ b + y.mean(0), 1)

    assert predicted(crossval.cross_validated(table, "label", crossval.pls_da(3))) == by_hand(data, model)


@pytest.mark.parametrize("quadratic", [False, True])
def test_discriminants(table, data, quadratic):
    def model(x, of, new):
        m, p = front(x, 3)
        t, u, scores = (x - m) @ p, (new - m) @ p, []
        within = sum(np.cov(t[of == c].T) * ((of == c).sum() - 1) for c in range(3)) / (len(x) - 3)
        for c in range(3):
            s = np.cov(t[of == c].T) if quadratic else within
            d = u - t[of == c].mean(0)
            scores.append(-0.5 * (d @ np.linalg.inv(s) * d).sum(1) - (0.5 * np.linalg.slogdet(s)[1] if quadratic else 0) + np.log((of == c).mean()))
        return np.argmax(np.stack(scores, 1), 1)

    assert predicted(crossval.cross_validated(table, "label", crossval.discriminant(3, quadratic))) == by_hand(data, model)


def test_knn(table, data):
    def model(x, of, new):
        m, p = front(x, 3)
        d = (((new - m) @ p)[:, None] - ((x - m) @ p)[None]) ** 2
        near = np.argsort(d.sum(2), axis=1, kind="stable")[:, :5]
        return [np.argmax(np.bincount(of[i], minlength=3)) for i in near]

    assert predicted(crossval.knn_cross_validated(table, "label", 3, 5)) == by_hand(data, model)


def test_logistic(table, data):
    def model(x, of, new):
        m, p = front(x, 3)
        t, w, y = np.column_stack([np.ones(len(x)), (x - m) @ p]), np.zeros((4, 3)), np.eye(3)[of]
        for _ in range(20_000):
            e = np.exp(t @ w)
            grad = t.T @ (e / e.sum(1, keepdims=True) - y) / len(x)
            grad[1:] += w[1:] / len(x)
            w -= 0.2 * grad
        return np.argmax(np.column_stack([np.ones(len(new)), (new - m) @ p]) @ w, 1)

    got, want = predicted(crossval.logistic_cross_validated(table, "label", 3)), by_hand(data, model)
    assert sum(got[k] == want[k] for k in want) >= 89  # a row on the border may fall either way


def test_simca_and_its_metrics(table, data):
    x, of, fold, _ = data
    rows = crossval.accepted(table, "label", 2)
    got = {(r.sample_idx, r.model): r.h for r in rows.collect()}
    assert len(got) == 270
    for c in range(3):
        own = x[(fold != 0) & (of == c)]
        m, p = front(own, 2)
        model = kernels.pca(own - m, 2, len(own))
        top = decomposition.limits(model, 0.05, new=True)
        for i in np.flatnonzero(fold == 0):
            t2, spe = decomposition.row_distances(x[i][None], m, model)
            assert np.isclose(got[int(i), "abc"[c]], max(t2[0] / top["t2"], spe[0] / top["spe"]))
    table_ = {r["class"]: r for r in crossval.simca_class_metrics(rows).collect()}
    for c in "abc":
        assert np.isclose(table_[c].sensitivity, np.mean([got[i, c] <= 1 for i in range(90) if "abc"[of[i]] == c]))
        assert np.isclose(table_[c].specificity, np.mean([got[i, c] > 1 for i in range(90) if "abc"[of[i]] != c]))
    assert np.isclose(table_[None].sensitivity, np.mean([got[i, "abc"[of[i]]] <= 1 for i in range(90)]))


def test_two_classes(table, data):
    two = table.where("label <> 'c'")
    got = crossval.cross_validated(two, "label", crossval.opls_da(2))
    same = crossval.cross_validated(two, "label", crossval.pls_da(3))  # OPLS with 2 orthogonal components predicts as PLS with 3
    a, b = ({r.sample_idx: r.scores[0] for r in d.collect()} for d in (got, same))
    assert all(np.isclose(a[k], b[k], atol=1e-8) for k in a) and len(a) == 60
    y = {i: float(data[1][i] == 1) for i in a}
    rmse = crossval.dummy_rmse(got, "observed", ["a", "b"]).first()["rmse"]
    assert np.isclose(rmse, np.sqrt(np.mean([(a[i] - y[i]) ** 2 for i in a])))


def test_refusals(table):
    with pytest.raises(Refused, match="OPLS-DA"):
        crossval.cross_validated(table, "label", crossval.opls_da(1))
    with pytest.raises(Refused, match="without class"):
        crossval.training_groups(table.where("label <> 'c' or fold = 0"), "label")
    with pytest.raises(Refused, match="two folds"):
        crossval.training_groups(table.where("fold = 0"), "label")


def test_pls_diagnostics(table, data):
    x, _, _, y = data
    xc, yc = x - x.mean(0), y - y.mean()
    m = kernels.pls(xc, yc, 3)
    got = regression.pls_explained(table, "y", 3).orderBy("a").collect()
    left_x, left_y = [(xc**2).sum()], [(yc**2).sum()]
    for a in range(1, 4):
        t = xc @ m.rotations[:, :a]
        left_x.append(((xc - t @ m.p[:, :a].T) ** 2).sum())
        left_y.append(((yc - t @ m.q[:a]) ** 2).sum())
    assert np.allclose([r.x for r in got], -np.diff(left_x) / left_x[0]) and np.allclose([r.y_total for r in got], 1 - np.array(left_y[1:]) / left_y[0])
    t = xc @ m.rotations
    t2, e = (t**2 / (t.var(0, ddof=1))).sum(1), xc - t @ m.p.T
    rows = {r.sample_idx: r for r in regression.pls_distances(table, "y", 3).collect()}
    assert np.allclose([rows[i].t2 for i in range(90)], t2) and np.allclose([rows[i].spe for i in range(90)], (e * e).sum(1))
    assert rows[0].spe_limit > np.median((e * e).sum(1)) and rows[0].t2_limit > np.median(t2)
    with pytest.raises(Refused, match="noise"):
        regression.pls_distances(table, "y", 7)


def test_class_diagnostics(table, data):
    x, of, _, _ = data
    rows = {r.sample_idx: r for r in outliers.by_class(table, "label", 2).collect()}
    for c in range(3):
        own = np.flatnonzero(of == c)
        m, p = front(x[own], 2)
        t = (x[own] - m) @ p
        hat = np.column_stack([np.ones(len(own)), t])
        assert np.allclose([rows[i].leverage for i in own], np.diag(hat @ np.linalg.inv(hat.T @ hat) @ hat.T))
        assert np.allclose([rows[i].t2 for i in own], (t**2 / t.var(0, ddof=1)).sum(1))


def test_contributions_sum_to_the_distances(table, data):
    model, mean = decomposition.fit_pca(table, 3)
    rows = decomposition.contributions(table, model, mean).collect()
    t2, spe = decomposition.row_distances(data[0], mean, model)
    sums, squares = np.zeros(90), np.zeros(90)
    for r in rows:
        sums[r.sample_idx] += r.t2_part
        squares[r.sample_idx] += r.residual2
    assert len(rows) == 630 and np.allclose(sums, t2) and np.allclose(squares, spe)


def test_positions_and_permutations(spark, table):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 as sample_idx", "id % 3 as level", "id as v").repartition(7)
    assert sorted((r.place, r.sample_idx) for r in order.numbered(rows, "sample_idx", into="place").collect()) == [(k, k) for k in range(1000)]
    odd = rows.selectExpr("case when sample_idx % 10 > 0 then sample_idx % 7 end as a", "concat('x', sample_idx % 5) as b", "sample_idx")
    got = [r.place for r in sorted(order.numbered(odd, "a", "b", "sample_idx", into="place", rows_a_range=30).collect(), key=lambda r: (r.a is not None, r.a, r.b, r.sample_idx))]
    assert got == list(range(1000))
    folds = splits.k_fold(rows, 7, order="hash")
    splits.validate_partition(rows, folds)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [142] * 1 + [143] * 6
    level = {r.sample_idx: r.level for r in rows.collect()}
    first = sorted(r.sample_idx for r in splits.stratified_train_test(rows, "level", 0.1).collect())
    assert first == sorted(i for c in range(3) for i in sorted(k for k in level if level[k] == c)[: -(-sum(v == c for v in level.values()) // 10)])
    shuffled = selection._permuted(table, "y", 4, 3).collect()
    values = sorted(r.y for r in shuffled)
    for k in range(4):
        assert sorted(r[f"_p{k}"] for r in shuffled) == values and sum(r[f"_p{k}"] == r.y for r in shuffled) < 20


def test_permutation_test_and_bootstrap(table, data):
    x, _, fold, y = data
    error, permuted, p = selection.permutation_test(table, "y", 2, 19)
    want = regression.rmsecv_curve(table, "y", regression.pls_path(2)).where("a = 2").first()["rmsecv"]
    assert np.isclose(error, want) and p == 0.05 and min(permuted) > error
    got = {r.var_idx: r for r in selection.bootstrap_coefficients(table, "y", 7, 60).collect()}
    xc = x - x.mean(0)
    b = np.linalg.lstsq(xc, y - y.mean(), rcond=None)[0]
    assert all(got[k].lo < b[k] + 0.2 and got[k].hi > b[k] - 0.2 for k in range(7)) and all(0 < got[k].hi - got[k].lo < 3 for k in range(7))


def test_tree_of_factors(table, data):
    want = fold_factors(table, ["y"], levels=()).orderBy("fold").collect()
    got = fold_factors(table, ["y"], levels=(4, 2)).orderBy("fold").collect()
    for a, b in zip(got, want, strict=True):
        ra, rb = (factor(r, 1)[1] for r in (a, b))
        assert a.n == b.n == 18 and np.allclose(ra.T @ ra, rb.T @ rb)


def test_exclude_numbers_anew(table):
    got = sorted(r.sample_idx for r in outliers.exclude(table, [0, 17, 89, 17]).collect())
    assert got == list(range(87))
    kept = {tuple(r.x): r.sample_idx for r in outliers.exclude(table, [3]).collect()}
    assert all(kept[tuple(r.x)] == r.sample_idx - (r.sample_idx > 3) for r in table.collect() if r.sample_idx != 3)


def test_logistic_and_svm_on_training_rows(table):
    for got in (classification.logistic(table, "label", 5), classification.svm(table, "label", 5)):
        rows = got.collect()
        assert len(rows) == 90 and np.mean([r.observed == r.predicted for r in rows]) > 0.5


def descended(t, value, slope, n=60_000):
    """Weights and constant of least |w|^2 / 2 + 1/2 sum of squared losses, by plain gradient descent."""
    w, b = np.zeros(t.shape[1]), 0.0
    rate = 1 / (1 + np.linalg.norm(np.column_stack([t, np.ones(len(t))]), 2) ** 2)
    for _ in range(n):
        g = slope(value, t @ w + b)
        w, b = w - rate * (w + t.T @ g), b - rate * g.sum()
    return w, b


def test_kernel_machines_with_a_linear_kernel(table, data):
    x, of, fold, y = data
    m, p = front(x, 3)
    t = (x - m) @ p
    votes = np.zeros((90, 3))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        use = (of == i) | (of == j)
        w, b = descended(t[use], np.where(of[use] == i, 1.0, -1.0), lambda s, f: -s * np.maximum(1 - s * f, 0))
        votes[np.arange(90), np.where(t @ w + b > 0, i, j)] += 1
    got = predicted(kernel_machines.svm(table, "label", 3, kind="linear"))
    assert sum(got[k] == "abc"[votes[k].argmax()] for k in range(90)) >= 89
    rows = {r.sample_idx: r.p for r in kernel_machines.svr(table, "y", 3, kind="linear").collect()}
    for k in range(5):
        m, p = front(x[fold != k], 3)
        w, b = descended((x[fold != k] - m) @ p, y[fold != k], lambda v, f: -np.sign(v - f) * np.maximum(np.abs(v - f) - 0.1, 0))
        at = np.flatnonzero(fold == k)
        assert np.allclose([rows[i] for i in at], (x[at] - m) @ p @ w + b, atol=1e-3)


def test_kernel_machines_bend(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    rows = [(i, v.tolist(), "in" if v @ v < 1.2 else "out", float(np.sin(2 * v[0]) + v[1] ** 2), i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_idx bigint, x array<double>, label string, y double, fold int")
    got = kernel_machines.svm(df, "label", 2, c=10.0).collect()
    assert np.mean([r.observed == r.predicted for r in got]) > 0.95
    held = kernel_machines.svr(df, "y", 2, c=10.0, gamma=1.0).collect()
    assert np.sqrt(np.mean([(r.y - r.p) ** 2 for r in held])) < 0.35 * np.std([r.y for r in held])


def test_robust_distances(spark):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(300, 2)) @ np.array([[2.0, 0.5], [0, 1]])
    t[:40] += [15, -9]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(t)], "sample_idx bigint, t array<double>").repartition(3)
    got = {r.sample_idx: r.d2 for r in outliers.robust(df, 2).collect()}
    chi = {0.5: 1.3862943611198906, 0.975: 7.377758908227871}
    want = kernels.robust_distances(t, lambda p, _: chi[p], 500, 0)
    assert np.allclose([got[i] for i in range(300)], want, rtol=0.05, atol=0.05) and min(got[i] for i in range(40)) > 20 * np.median(list(got.values()))
    far = {r.sample_idx for r in outliers.robust(df, 2, most_rows=100).collect() if r.d2 > 25}  # the starts come from a sample
    assert far == set(range(40))
    with pytest.raises(Refused):
        outliers.robust(df.limit(2), 2)
