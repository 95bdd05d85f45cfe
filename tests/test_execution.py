"""Declared pipelines that run: shared prefixes, stored folds, reuse, routing of splits, failures that name their node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused
from spectrail.operators import kernels, splits
from spectrail.operators import preprocess as pre
from spectrail.plans import catalog, routing
from spectrail.plans.execution import Execution, NodeFailed
from spectrail.plans.models import Model
from spectrail.plans.pipeline import Node, Pipeline
from spectrail.plans.store import ALL, Store

RNG = np.random.default_rng(21)
N, P, K = 60, 8, 4
X = RNG.normal(size=(N, 3)) @ RNG.normal(size=(3, P)) + 0.3 * RNG.normal(size=(N, P)) + 4 + np.arange(P)
Y = X @ RNG.normal(size=P) + 0.1 * RNG.normal(size=N)
FOLD = np.arange(N) * K // N


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, X[i].tolist(), float(Y[i]), "abc"[int(i % 3)], f"g{i % 7}", 99) for i in range(N)]
    return spark.createDataFrame(rows, "sample_idx bigint, x array<double>, y double, kind string, site string, fold int").repartition(3).cache()


def forest():
    return Pipeline((
        Node.of("source", "source"),
        Node.of("snv", "snv", "source"), Node.of("snv_centre", "mean_centre", "snv"), Node.of("snv_pca", "pca", "snv_centre", n_components=2),
        Node.of("msc", "msc", "source"), Node.of("msc_centre", "mean_centre", "msc"), Node.of("msc_pca", "pca", "msc_centre", n_components=2),
        Node.of("sg", "savgol", "source", window_length=5, polyorder=2, deriv=1), Node.of("sg_scale", "autoscale", "sg"), Node.of("sg_pca", "pca", "sg_scale", n_components=2),
        Node.of("sg2", "savgol", "snv", window_length=5, polyorder=2, deriv=1), Node.of("split", "kfold", "sg2", n_splits=K, shuffle=False), Node.of("centre", "mean_centre", "split"), Node.of("held_pca", "pca", "centre", n_components=2),
    ))


def matrix(df):
    return np.array([r.x for r in df.orderBy("sample_idx").collect()])


def snv(x):
    return (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)


def sg(x):
    return x @ pre.SavGol(5, 2, 1).matrix(P).T


@pytest.mark.parametrize("keep", ["all", "shared"])
def test_forest_runs_once(spark, table, tmp_path, keep):
    store = Store(spark, str(tmp_path))
    first = Execution(forest(), table, "v1", store, keep).run()
    assert first.summary() | {"seconds": 0} == {"computed": 13, "reused": 0, "failed": 0, "seconds": 0, "failed_node": None}
    again = Execution(forest(), table.where("1 / 0 > 0"), "v1", store, keep)  # a source that would fail if anything were computed
    second = again.run()
    assert second.summary() == {"computed": 0, "reused": 13, "failed": 0, "seconds": 0, "failed_node": None} and second.metrics == first.metrics
    assert np.allclose(matrix(again.matrix("snv").df), snv(X))
    assert Execution(forest(), table, "v2", store).known == {}
    c = snv(X) - snv(X).mean(0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    numbers = {(part, name): v for part, name, v in first.metrics["snv_pca"]}
    assert np.isclose(numbers["calibration", "explained_1"], s[0] / s.sum())
    changed = Pipeline(tuple(n if n.id != "sg_scale" else Node.of("sg_scale", "autoscale", "sg", ddof=0) for n in forest().nodes))
    third = Execution(changed, table, "v1", store, keep).run()
    assert sorted(third.nodes("computed")) == ["sg_pca", "sg_scale"] and len(third.nodes("reused")) == 11


def test_folds_have_their_own_parameters(spark, table, tmp_path):
    run = Execution(forest(), table, "v1", Store(spark, str(tmp_path)))
    run.run()
    z = sg(snv(X))
    centre = run.matrix("centre")
    assert centre.versioned and centre.folds == list(range(K))
    assert np.allclose(matrix(centre.everything()), z - z.mean(0), atol=1e-12)
    for k in range(K):
        assert np.allclose(matrix(centre.df.where(F.col("fold") == k)), z - z[FOLD != k].mean(0), atol=1e-12)
    assert np.allclose(matrix(centre.display()), np.stack([z[i] - z[FOLD != FOLD[i]].mean(0) for i in range(N)]), atol=1e-12)
    rows = {r.sample_idx: r for r in run.results("held_pca").where("part = 'cross_validation'").collect()}
    for k in range(K):
        train = z[FOLD != k] - z[FOLD != k].mean(0)
        p = kernels.pca(train, 2).loadings
        t = (z[FOLD == k] - z[FOLD != k].mean(0)) @ p
        assert np.allclose(np.abs([rows[i].t for i in np.flatnonzero(FOLD == k)]), np.abs(t), atol=1e-8)
    assert run.governing("centre").id == "split" and run.governing("snv") is None


def test_a_wrong_number_of_folds_is_a_miss(spark, table, tmp_path):
    import shutil

    store = Store(spark, str(tmp_path))
    run = Execution(forest(), table, "v1", store)
    run.run()
    shutil.rmtree(f"{tmp_path}/matrices/key={run.keys['centre']}/fold=2")
    shutil.rmtree(f"{tmp_path}/commits/key={run.keys['msc']}")
    again = Execution(forest(), table, "v1", store)
    assert set(run.keys) - set(again.known) == {"source", "centre", "msc"}
    assert sorted(again.run().nodes("computed")) == ["centre", "msc"]
    assert Execution(forest(), table, "v1", store).run().summary()["computed"] == 0


@pytest.mark.parametrize("split", [{"kind": "kfold", "n_splits": K, "shuffle": False}, {"kind": "train_test", "test_size": 0.3, "shuffle": False}, {"kind": "loo", "group_by": "site"}])
def test_fitted_chains_below_splits(spark, table, tmp_path, split):
    """Scaling, scatter correction against a median, and regression, all refitted without each fold."""
    options = {k: v for k, v in split.items() if k != "kind"}
    plan = Pipeline((
        Node.of("source", "source"), Node.of("split", split["kind"], "source", **options), Node.of("msc", "msc", "split", reference="median"), Node.of("scale", "autoscale", "msc"),
        Node.of("pls", "pls", "scale", target="y", n_components=2), Node.of("ridge", "ridge", "split", target="y", alpha=0.5),
    ))
    run = Execution(plan, table, "v1", Store(spark, str(tmp_path)))
    done = run.run()
    held = {r.sample_idx: r.fold for r in routing.folds_of(table, split["kind"], options).collect()}
    fold = np.array([held.get(i, -1) for i in range(N)])

    def msc(x, r):
        b = (x - x.mean(1, keepdims=True)) @ (r - r.mean()) / ((r - r.mean()) @ (r - r.mean()))
        return (x - (x.mean(1) - b * r.mean())[:, None]) / b[:, None]

    want, plain = np.full(N, np.nan), np.full(N, np.nan)
    for k in sorted(set(held.values())):
        z = msc(X, np.median(X[fold != k], axis=0))
        z = (z - z[fold != k].mean(0)) / z[fold != k].std(0, ddof=1)
        ym = Y[fold != k].mean()
        want[fold == k] = z[fold == k] @ kernels.pls(z[fold != k].copy(), Y[fold != k] - ym, 2).coefficients() + ym
        m = X[fold != k].mean(0)
        plain[fold == k] = (X[fold == k] - m) @ kernels.ridge(X[fold != k] - m, Y[fold != k] - ym, 0.5)[0] + ym
    for node, expected in (("pls", want), ("ridge", plain)):
        rows = run.results(node).where("part = 'cross_validation'").collect()
        assert sorted(r.sample_idx for r in rows) == sorted(held) and np.allclose([r.p for r in rows], [expected[r.sample_idx] for r in rows], atol=1e-8)
        numbers = {(a, b): v for a, b, v in done.metrics[node]}
        assert np.isclose(numbers["cross_validation", "rmsecv"], np.sqrt(np.mean([(r.y - r.p) ** 2 for r in rows])))
    whole = run.results("ridge").where("part = 'calibration'").orderBy("sample_idx").collect()
    c = X - X.mean(0)
    assert np.allclose([r.p for r in whole], c @ kernels.ridge(c, Y - Y.mean(), 0.5)[0] + Y.mean())
    saved = Model.load(spark, run.known["ridge"].files["model"]).apply(table)
    assert np.allclose([r.p for r in saved.orderBy("sample_idx").collect()], [r.p for r in whole])


def test_every_estimator_runs_above_and_below_a_split(spark, table, tmp_path):
    a = [
        ("pcr", {"target": "y", "n_components": 2}), ("elastic_net", {"target": "y", "alpha": 0.01}), ("mlr", {"target": "y"}), ("opls", {"target": "y"}), ("svr", {"target": "y", "n_components": 2}),
        ("plsda", {"class_column": "kind", "n_components": 2}), ("lda", {"class_column": "kind", "n_components": 2}), ("qda", {"class_column": "kind", "n_components": 2}), ("simca", {"class_column": "kind", "n_components": 2}),
        ("knn", {"class_column": "kind", "n_components": 2, "k": 3}), ("logistic", {"class_column": "kind", "n_components": 2}), ("svm", {"class_column": "kind", "n_components": 2}),
    ]
    nodes = [Node.of("source", "source"), Node.of("split", "kfold", "source", n_splits=3, stratify_by="kind"), Node.of("centre", "mean_centre", "split")]
    nodes += [Node.of(kind, kind, "centre", **o) for kind, o in a] + [Node.of("lda_above", "lda", "source", class_column="kind", n_components=2)]
    run = Execution(Pipeline(tuple(nodes)), table, "v1", Store(spark, str(tmp_path)))
    done = run.run()
    assert done.summary()["computed"] == len(nodes) - 1
    for kind, _ in a:
        parts = {(r["part"]): r["count"] for r in run.results(kind).groupBy("part").count().collect()}
        assert parts == {"calibration": N, "cross_validation": N}, kind
        names = {(p, n) for p, n, _ in done.metrics[kind]}
        assert ("cross_validation", "rmsecv") in names or ("cross_validation", "accuracy") in names
    row = done.experiment("e1", "p1", "v1")
    assert row[4] == "succeeded" and row[3]
    spark.createDataFrame([(*row, None)], catalog.EXPERIMENT).collect()


def test_failures_name_their_node(spark, table, tmp_path):
    plan = Pipeline((Node.of("source", "source"), Node.of("good", "snv", "source"), Node.of("wide", "savgol", "good", window_length=21), Node.of("after", "pca", "wide", n_components=2)))
    store = Store(spark, str(tmp_path))
    with pytest.raises(NodeFailed, match="wide") as failed:
        Execution(plan, table, "v1", store).run()
    assert failed.value.node_id == "wide" and failed.value.run.outcome == {"good": "computed", "wide": "failed"}
    assert Execution(plan, table, "v1", store).known.keys() == {"good"}
    for kind, o, why in (("pls", {"target": "none", "n_components": 1}, "isn't a column"), ("pls", {"target": "y"}, "needs n_components"), ("knn", {"class_column": "kind", "n_components": 1, "k": 3, "q": 1}, "no option q")):
        with pytest.raises(NodeFailed, match=why):
            Execution(Pipeline((Node.of("source", "source"), Node.of("m", kind, "source", **o))), table, "v1", store).run()


def test_range_on_a_narrowed_axis(spark, table, tmp_path):
    plan = Pipeline((Node.of("source", "source"), Node.of("some", "select_variables", "source", indices=(1, 3, 5, 7)), Node.of("range", "range_select", "some", start=30.0, end=60.0)))
    run = Execution(plan, table, "v1", Store(spark, str(tmp_path)), axis=10.0 * np.arange(P))
    run.run()
    assert np.allclose(matrix(run.matrix("range").df), X[:, [3, 5]])
    with pytest.raises(NodeFailed, match="axis"):
        Execution(plan, table, "v9", Store(spark, str(tmp_path))).run()


def test_routing(spark, table):
    grouped = {r.sample_idx: r.fold for r in routing.folds_of(table, "kfold", {"n_splits": 3, "group_by": "site"}).collect()}
    assert len(grouped) == N and all(grouped[i] == grouped[i % 7] for i in range(N)) and len(set(grouped.values())) == 3
    strata = routing.folds_of(table, "kfold", {"n_splits": 4, "stratify_by": "kind"}).join(table.select("sample_idx", "kind"), "sample_idx").groupBy("fold", "kind").count().collect()
    assert {r["count"] for r in strata} == {5}
    assert routing.folds_of(table, "train_test", {"test_size": 0.25, "stratify_by": "kind"}).count() == 15
    assert routing.folds_of(table, "kfold", {}).collect() and {tuple(r) for r in routing.folds_of(table, "kfold", {}).collect()} == {tuple(r) for r in routing.folds_of(table, "kfold", {}).collect()}
    assert {tuple(r) for r in routing.folds_of(table, "kfold", {"n_splits": 5, "order": "numpy"}).collect()} == {tuple(r) for r in splits.k_fold(table, 5).collect()}
    for kind, o, why in (
        ("kfold", {"group_by": "site", "stratify_by": "kind"}, "not by both"), ("repeated_kfold", {}, "no splitter"), ("external", {}, "no splitter"), ("other", {}, "isn't known"), ("loo", {"stratify_by": "kind"}, "no option"),
        ("kfold", {"group_by": "nowhere"}, "there are fold, kind, site, y"), ("kfold", {"n_splits": 1}, "two folds"), ("train_test", {"test_size": 1.0}, "between"), ("kfold", {"n_splits": 9, "group_by": "site"}, "can't make"),
    ):
        with pytest.raises(Refused, match=why):
            routing.folds_of(table, kind, o)
    with pytest.raises(Refused, match="null"):
        routing.folds_of(table.withColumn("site", F.when(F.col("sample_idx") > 0, F.col("site"))), "kfold", {"group_by": "site"})
    assert ALL == -1


def test_models_of_every_estimator_score_streams(spark, table, tmp_path):
    """What a node stores scores later rows as the node scored its own, in batches and streams."""
    kinds = {
        "simca": {"n_components": 2}, "lda": {"n_components": 2}, "qda": {"n_components": 2}, "knn": {"n_components": 2, "k": 5}, "logistic": {"n_components": 2}, "svm": {"n_components": 2}, "plsda": {"n_components": 2},
    }
    nodes = [Node.of("source", "source"), Node.of("snv", "snv", "source"), Node.of("scale", "autoscale", "snv")]
    nodes += [Node.of(k, k, "scale", class_column="kind", **o) for k, o in kinds.items()]
    nodes += [Node.of("two_logistic", "logistic", "scale", class_column="half", n_components=2), Node.of("svr", "svr", "scale", target="y", n_components=2, C=5.0), Node.of("pca", "pca", "scale", n_components=2)]
    source = table.withColumn("half", F.col("sample_idx") % 2)
    run = Execution(Pipeline(tuple(nodes)), source, "v1", Store(spark, str(tmp_path / "store")))
    run.run()
    rows = table.select("sample_idx", "x")
    rows.write.parquet(str(tmp_path / "rows"))
    for node in [*kinds, "two_logistic", "svr", "pca"]:
        model = Model.load(spark, run.known[node].files["model"])
        batch = {r.sample_idx: r for r in model.apply(rows).collect()}
        own = {r.sample_idx: r for r in run.results(node).where("part = 'calibration'").collect()}
        field = "p" if node == "svr" else "t2" if node == "pca" else "predicted"
        for i in range(N):
            assert np.isclose(batch[i][field], own[i][field], atol=1e-6) if field != "predicted" else batch[i][field] == own[i][field], (node, i)
        if node == "simca":
            assert all(("abc"[k] in batch[i].accepted) == (own[i].scores[k] <= 1) for i in range(N) for k in range(3))
        stream = model.apply(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))).writeStream.format("parquet").option("path", str(tmp_path / f"out-{node}")).option("checkpointLocation", str(tmp_path / f"marks-{node}")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        streamed = {r.sample_idx: r[field] for r in spark.read.parquet(str(tmp_path / f"out-{node}")).collect()}
        assert streamed == {i: batch[i][field] for i in range(N)}
        if node not in ("plsda", "svr", "pca"):
            with pytest.raises(Refused, match="no coefficients"):
                model.coefficients()


def test_only_splits_are_stored(spark, table, tmp_path):
    """Parameters suffice: no row is stored once a fold, and the numbers are those of stored matrices."""
    plan = Pipeline((
        Node.of("source", "source"), Node.of("split", "loo", "source", group_by="site"), Node.of("scale", "autoscale", "split"), Node.of("centre", "mean_centre", "scale"),
        Node.of("model", "mlr", "centre", target="y"), Node.of("classes", "lda", "centre", class_column="kind", n_components=2),
    ))
    stored = Execution(plan, table, "v1", Store(spark, f"{tmp_path}/a")).run()
    run = Execution(plan, table, "v1", Store(spark, f"{tmp_path}/b"), "splits")
    derived = run.run()
    for node in ("model", "classes"):
        assert [m[:2] for m in derived.metrics[node]] == [m[:2] for m in stored.metrics[node]]
        assert np.allclose([m[2] for m in derived.metrics[node]], [m[2] for m in stored.metrics[node]])
    assert [i for i, c in run.known.items() if c.rows] == ["split"] and run.known["split"].rows == {ALL: N}
    again = Execution(plan, table.where("1 / 0 > 0"), "v1", Store(spark, f"{tmp_path}/b"), "splits")
    assert again.run().summary()["reused"] == 5 and np.allclose(matrix(again.matrix("centre").everything()).mean(0), 0, atol=1e-12)
    assert again.matrix("centre").held_out().count() == N


def test_one_column_deals_a_numbering_where_it_can(spark):
    from spectrail.operators.order import numbered

    rows = [(i // 3, (7 * i) % 5, i) for i in range(900)] + [(None, 1, 900), (5, None, 901)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(3)
    for by in (("a", "b", "c"), ("b", "a", "c")):  # b has five values, so it can't
        order = sorted(rows, key=lambda r: [(r["abc".index(k)] is not None, r["abc".index(k)] or 0) for k in by])
        assert [(r.a, r.b, r.c) for r in numbered(df, *by, rows_a_range=40).orderBy("sample_idx").collect()] == order
