"""Support vector machines with their defined losses against the solver in one piece, and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused
from spectrail.operators import classification, dual, kernels, neighbours, regression

RNG = np.random.default_rng(12)


def variables(spark, t, z, lo, hi, partitions=4):
    rows = [(0, k, t[k].tolist(), float(z[k]), float(lo[k]), float(hi[k]), 0.0, 0.0) for k in range(len(t))]
    return spark.createDataFrame(rows, "machine int, var bigint, t array<double>, z double, lo double, hi double, beta double, f double").repartition(partitions)


@pytest.mark.parametrize("working", [300, 4096])
def test_classifier_reaches_the_objective(spark, working):
    t = RNG.normal(size=(2000, 3))
    sign = np.where((t**2).sum(1) + RNG.normal(size=2000) > 3, 1.0, -1.0)
    c, gamma = 1.0, 0.3
    k = kernels.kernel(t, t, "rbf", gamma)
    alpha, rho = kernels.smo(k, sign, -np.ones(2000), c, tol=1e-6)
    least = 0.5 * (alpha * sign) @ k @ (alpha * sign) - alpha.sum()
    got = dual.solve(variables(spark, t, sign, np.where(sign > 0, 0, -c), np.where(sign > 0, c, 0)), "rbf", {0: gamma}, tol=1e-5, working=working)
    assert abs(got.objective[0] - least) <= 1e-6 * abs(least) and got.gap[0] < 1e-5
    assert abs(got.constant[0] + rho) < 1e-3
    beta = np.array([r.beta for r in got.rows.orderBy("var").collect()])
    assert abs(beta.sum()) < 1e-8 and (beta * sign >= 0).all() and (beta * sign <= c).all()
    decided = np.array([r.decision for r in got.decided().orderBy("var").collect()])
    assert np.allclose(decided, k @ (alpha * sign) - rho, atol=2e-3)


def test_regression_by_fold_and_along_the_grid(spark):
    x = RNG.normal(size=(120, 4))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + 0.05 * RNG.normal(size=120) + 5
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(120)], "sample_idx bigint, x array<double>, y double, fold int").repartition(3)
    got = {r.sample_idx: r.p for r in regression.svr(df, "y", 2, c=2.0, epsilon=0.05, tol=1e-6).collect()}
    want, errors = np.zeros(120), {}
    for k in range(3):
        train = np.arange(120) % 3 != k
        m = x[train].mean(0)
        p = kernels.pca(x[train] - m, 2).loadings
        a, b, v = (x[train] - m) @ p, (x[~train] - m) @ p, y[train]
        g = 1 / (2 * a.var())
        for c in (2.0, *np.ptp(y) * np.logspace(-3, 0, 4)):
            kk = kernels.kernel(a, a, "rbf", g)
            alpha, rho = kernels.smo(np.tile(kk, (2, 2)), np.repeat([1.0, -1.0], len(a)), np.concatenate([0.05 - v, 0.05 + v]), c, tol=1e-7)
            f = kernels.kernel(b, a, "rbf", g) @ (alpha[: len(a)] - alpha[len(a) :]) - rho
            errors.setdefault(c, []).append((y[~train] - f) ** 2)
            if c == 2.0:
                want[~train] = f
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-4)
    curve = regression.svr_curve(df, "y", 2, epsilon=0.05, points=4, tol=1e-6).orderBy("c").collect()
    for r, c in zip(curve, np.ptp(y) * np.logspace(-3, 0, 4), strict=True):
        e2 = np.concatenate(errors[c])
        assert np.isclose(r.c, c) and np.isclose(r.rmsecv, np.sqrt(e2.mean()), atol=1e-4) and np.isclose(r.q2, 1 - e2.sum() / ((y - y.mean()) ** 2).sum(), atol=1e-4)


def test_votes_of_pairs(spark):
    x = RNG.normal(size=(150, 3))
    of = np.where(x[:, 0] > 0.4, 0, np.where(x[:, 1] > 0, 1, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), "abc"[of[i]]) for i in range(150)] + [(150, [0.0, 0.0, 0.0], None)], "sample_idx bigint, x array<double>, label string")
    m = x.mean(0)
    t = (x - m) @ kernels.pca(x - m, 2).loadings
    g, votes = 1 / (2 * t.var()), np.zeros((150, 3))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        use = (of == i) | (of == j)
        sign = np.where(of[use] == i, 1.0, -1.0)
        alpha, rho = kernels.smo(kernels.kernel(t[use], t[use], "rbf", g), sign, -np.ones(use.sum()), 1.0, tol=1e-7)
        votes[np.arange(150), np.where(kernels.kernel(t, t[use], "rbf", g) @ (alpha * sign) - rho > 0, i, j)] += 1
    got = {r.sample_idx: r.predicted for r in classification.svm(df, "label", 2, tol=1e-6).collect()}
    assert len(got) == 150 and sum(got[i] == "abc"[votes[i].argmax()] for i in range(150)) >= 149


def test_dual_refuses(spark):
    t = RNG.normal(size=(30, 2))
    sign = np.where(np.arange(30) % 2, 1.0, -1.0)
    rows = variables(spark, t, sign, np.where(sign > 0, 0, -9), np.where(sign > 0, 9, 0))
    with pytest.raises(Refused, match="didn't converge"):
        dual.solve(rows, "rbf", {0: 1.0}, tol=1e-9, working=4, most_rounds=2)
    with pytest.raises(Refused, match="kernel"):
        dual.solve(rows, "cubic", {0: 1.0})


def brute(t, q, k):
    d = np.round(np.maximum((q**2).sum(1)[:, None] + (t**2).sum(1)[None] - 2 * q @ t.T, 0), 9)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("shape", ["clusters", "one_place", "ties"])
def test_neighbours_are_brute_force(spark, shape):
    n = 1500
    x = {"clusters": RNG.normal(size=(n, 2)) + RNG.integers(0, 12, (n, 1)) * 9, "one_place": np.vstack([np.ones((n // 2, 2)), RNG.normal(size=(n - n // 2, 2))]), "ties": RNG.integers(0, 6, (n, 2)).astype(float)}[shape]
    df = spark.createDataFrame([(i, x[i].tolist(), int(i % 4)) for i in range(n)], "sample_idx bigint, x array<double>, label int").repartition(5)
    count = {}
    got = neighbours.nearest_rows(df, df.where("sample_idx % 3 = 0"), "label", 7, block_rows=40, query_rows=50, pivots=20, count=count)
    found: dict = {}
    for r in got.orderBy("sample_idx", "rank").collect():
        found.setdefault(r.sample_idx, []).append(r.neighbour)
    want = brute(x, x[::3], 7)
    assert len(found) == len(want) and all(found[3 * k] == want[k].tolist() for k in range(len(want)))
    assert count["all"] == n * len(want)
    if shape == "clusters":
        assert count["met"] < 0.2 * count["all"]


def test_neighbour_groups_are_bounded(spark, monkeypatch):
    """No group has more rows of a block or more queries than its bounds allow for, but for rows at one distance and the spread of hashes."""
    n = 3000
    x = RNG.normal(size=(n, 2)) * 0.01
    df = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(n)], "sample_idx bigint, x array<double>, label int").repartition(5)
    points, dealt, ranges = neighbours._blocks(df, n, 16, 100)
    assert ranges["n"].max() <= 220 and ranges["n"].sum() == n
    asked = df.select(F.lit(0).alias("block"), "sample_idx", "x")
    sizes = asked.withColumn("part", F.pmod(F.xxhash64("sample_idx"), F.lit(-(-n // 200)))).groupBy("part").count().agg(F.max("count")).first()[0]
    assert sizes <= 300


def test_neighbours_refuse_and_vote(spark):
    df = spark.createDataFrame([(0, [0.0], "b"), (1, [1.0], "a"), (2, [9.0], "b")], "sample_idx bigint, x array<double>, label string")
    with pytest.raises(Refused):
        neighbours.knn(df, df, "label", 4)
    assert {r.sample_idx: r.predicted for r in neighbours.knn(df, df, "label", 2).collect()} == {0: "a", 1: "a", 2: "a"}
    assert neighbours.knn(df, df.limit(0), "label", 2).count() == 0


def test_free_variables_stay_in_the_working_set(spark):
    """Labels without structure: sets of violators alone take over a hundred rounds."""
    rng, c, gamma = np.random.default_rng(9), 10.0, 0.3
    t, sign = rng.normal(size=(240, 3)), np.where(rng.random(240) < 0.5, 1.0, -1.0)
    alpha, _ = kernels.smo(kernels.kernel(t, t, "rbf", gamma), sign, -np.ones(240), c, tol=1e-6)
    least = 0.5 * (alpha * sign) @ kernels.kernel(t, t, "rbf", gamma) @ (alpha * sign) - alpha.sum()
    got = dual.solve(variables(spark, t, sign, np.where(sign > 0, 0, -c), np.where(sign > 0, c, 0)), "rbf", {0: gamma}, working=40, most_rounds=40)
    assert abs(got.objective[0] - least) <= 1e-5 * abs(least)


def test_classifiers_start_at_bounds_and_carry_no_rows(spark, monkeypatch):
    """Labels without structure, in several broadcasts: nearly all variables end at a bound, and rounds that start from zero bring a few there each."""
    for name, value in (("WORKING_AT_BOUNDS", 100), ("_SPREAD", 500), ("_SUPPORT", 300)):
        monkeypatch.setattr(dual, name, value, raising=False)
    rng, n, gamma = np.random.default_rng(4), 1200, 0.3
    t, of, learns = rng.normal(size=(n, 3)), rng.integers(0, 3, n), np.arange(n) % 10 > 0
    df = spark.createDataFrame([(i, 7, t[i].tolist(), bool(learns[i]), "abc"[of[i]]) for i in range(n)], "sample_idx bigint, machine int, t array<double>, learns boolean, label string")
    solved, pairs = dual.svm_solved(df, "label", ["a", "b", "c"], "rbf", {7: gamma}, 1.0, 1e-5)
    assert solved.rows.count() == 2 * learns.sum() and solved.rounds <= 25
    votes = np.zeros((n, 3))
    for p, (i, j) in enumerate(pairs):
        use = learns & ((of == i) | (of == j))
        sign, k = np.where(of[use] == i, 1.0, -1.0), kernels.kernel(t[use], t[use], "rbf", gamma)
        alpha, rho = kernels.smo(k, sign, -np.ones(use.sum()), 1.0, tol=1e-6)
        least = 0.5 * (alpha * sign) @ k @ (alpha * sign) - alpha.sum()
        assert abs(solved.objective[p] - least) <= 1e-6 * abs(least) and solved.gap[p] < 1e-5
        votes[np.arange(n), np.where(kernels.kernel(t, t[use], "rbf", gamma) @ (alpha * sign) - rho > 0, i, j)] += 1
    got = {r.sample_idx: (r.machine, r.learns, r.predicted) for r in dual.svm_votes(solved, df, "label", ["a", "b", "c"], "rbf", {7: gamma}).collect()}
    assert len(got) == n and all(got[i][:2] == (7, bool(learns[i])) for i in range(n))
    assert sum(got[i][2] == "abc"[votes[i].argmax()] for i in range(n)) >= n - 3


def test_choices_meet_from_many_partitions(spark):
    n = 900
    v = RNG.normal(size=n)
    rows = variables(spark, RNG.normal(size=(n, 2)), v, np.zeros(n), np.ones(n)).repartition(40)
    choose = lambda pdf: dual._chosen(pdf, 50, 1)
    assert set(choose(dual._met(rows, [0], choose).toPandas())["var"]) == set(np.argsort(v)[-25:])


@pytest.mark.parametrize("kind", ["rbf", "linear"])
@pytest.mark.parametrize("shape", ["noise", "copies", "followed", "few"])
def test_newtons_steps_solve_a_set(monkeypatch, shape, kind):
    """Without the plain solver, which is for what these steps leave; also from values that others' variables have made."""
    monkeypatch.setattr(dual, "_improved", lambda *a: pytest.fail("the steps didn't do"))
    rng, eps, c, gamma = np.random.default_rng(5), 0.1, 20.0, 0.3
    t = {"noise": rng.normal(size=(400, 3)), "copies": np.repeat(rng.normal(size=(80, 3)), 5, 0), "followed": rng.normal(size=(300, 2)), "few": rng.normal(size=(3, 2))}[shape]
    y = np.sin(t[:, 0]) if shape == "followed" else rng.normal(size=len(t))
    t, z, n = np.repeat(t, 2, 0), (y[:, None] + np.array([-eps, eps])).ravel(), len(t)
    lo, hi, f = np.tile([0.0, -c], n), np.tile([c, 0.0], n), 0.1 * np.cos(t[:, 0])
    beta = dual.by_newton(t, kind, gamma, z, lo, hi, np.zeros(2 * n), f, 1e-6)
    k = kernels.kernel(t, t, kind, gamma)
    v = z - f - k @ beta
    assert (beta >= lo).all() and (beta <= hi).all() and abs(beta.sum()) < 1e-8
    assert v[beta < hi].max() - v[beta > lo].min() < 1e-6


def test_bounds_of_a_curve_go_on_from_each_other(spark, monkeypatch):
    """A response without structure: nearly all support vectors are at a bound, and go from one to the next without kernel values, in sets much smaller than the machine."""
    monkeypatch.setattr(dual, "WORKING_NEAR_EDGES", 300, raising=False)
    rng, n, gamma, eps = np.random.default_rng(8), 700, 0.2, 0.1
    t, learns = rng.normal(size=(n, 2)), np.arange(n) % 7 > 0
    y = 0.15 * rng.normal(size=n) + 0.05 * np.sin(t[:, 0])
    grid, moved, added = (np.ptp(y) * np.logspace(-2, 0, 9)).tolist(), [], dual._added
    monkeypatch.setattr(dual, "_added", lambda state, changed, *rest: (moved.append(sum(len(m[0]) for m in changed.values())), added(state, changed, *rest))[1])
    df = spark.createDataFrame([(i, 3, t[i].tolist(), bool(learns[i]), float(y[i])) for i in range(n)], "sample_idx bigint, machine int, t array<double>, learns boolean, y double")
    curve = dual.svr_curve(df, "y", grid, "rbf", {3: gamma}, eps, 1e-5).orderBy("c").collect()
    k, v = kernels.kernel(t[learns], t[learns], "rbf", gamma), y[learns]
    for r, c in zip(curve, grid, strict=True):
        alpha, rho = kernels.smo(np.tile(k, (2, 2)), np.repeat([1.0, -1.0], len(v)), np.concatenate([eps - v, eps + v]), c, tol=1e-6)
        f = kernels.kernel(t[~learns], t[learns], "rbf", gamma) @ (alpha[: len(v)] - alpha[len(v) :]) - rho
        assert np.isclose(r.c, c) and np.isclose(r.rmsecv, np.sqrt(((y[~learns] - f) ** 2).mean()), atol=1e-4)
    support = int((alpha > 1e-9).sum())
    assert support > 200 and sum(moved) < 6 * support and len(moved) <= 45


def test_held_out_regression_comes_by_smaller_bounds(spark, monkeypatch):
    """A machine of several sets is solved for smaller bounds first, and then moves few variables for the one that is asked for."""
    monkeypatch.setattr(dual, "WORKING_NEAR_EDGES", 300, raising=False)
    rng, n, eps, bounds, moved, solve, added = np.random.default_rng(18), 600, 0.1, [], [], dual.solve, dual._added

    def solved(variables, *rest, **named):
        bounds.append(variables.agg(F.max("hi")).first()[0])
        moved.append(0)
        return solve(variables, *rest, **named)

    def counted(state, changed, *rest):
        moved[-1] += sum(len(m[0]) for m in changed.values())
        return added(state, changed, *rest)

    monkeypatch.setattr(dual, "solve", solved)
    monkeypatch.setattr(dual, "_added", counted)
    x = rng.normal(size=(n, 3))
    y, fold = 0.15 * rng.normal(size=n) + 0.05 * np.sin(x[:, 0]), np.arange(n) % 2
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(n)], "sample_idx bigint, x array<double>, y double, fold int")
    got = {r.sample_idx: r.p for r in regression.svr(df, "y", 2, c=1.0, epsilon=eps, tol=1e-5).collect()}
    support = 0
    for k in range(2):
        a = x[fold != k] - x[fold != k].mean(0)
        p, v = kernels.pca(a, 2).loadings, y[fold != k]
        b, a = (x[fold == k] - x[fold != k].mean(0)) @ p, a @ p
        g = 1 / (2 * a.var())
        alpha, rho = kernels.smo(np.tile(kernels.kernel(a, a, "rbf", g), (2, 2)), np.repeat([1.0, -1.0], len(v)), np.concatenate([eps - v, eps + v]), 1.0, tol=1e-6)
        want = kernels.kernel(b, a, "rbf", g) @ (alpha[: len(v)] - alpha[len(v) :]) - rho
        support += int((alpha > 1e-9).sum())
        assert np.allclose([got[i] for i in np.flatnonzero(fold == k)], want, atol=1e-3)
    assert bounds[-1] == 1.0 and len(bounds) > 1 and bounds == sorted(bounds)
    assert moved[-1] < support


@pytest.mark.parametrize("seed", range(8))
def test_newtons_steps_end_at_bounds(seed):
    """With bounds that leave no variable between them none stays there by rounding: the constant is then the middle of a range."""
    rng, c, n = np.random.default_rng(seed), 0.003, 80
    t, y = np.repeat(rng.normal(size=(n, 2)), 2, 0), rng.normal(size=n) + 5
    z, lo, hi, none = (y[:, None] + np.array([-0.05, 0.05])).ravel(), np.tile([0.0, -c], n), np.tile([c, 0.0], n), np.zeros(2 * n)
    got, want = (solver(t, "rbf", 0.3, z, lo, hi, none, none, 1e-6) for solver in (dual.by_newton, dual._improved))
    between = lambda beta: (beta > lo) & (beta < hi)
    assert np.allclose(got, want, atol=1e-5) and (between(got) <= between(np.where(np.abs(want - lo) < 1e-9, lo, np.where(np.abs(want - hi) < 1e-9, hi, want)))).all()
