"""Saved models, workbooks, MATLAB files, hashes, and steps without another test."""

import hashlib
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from spectrail.functions.arrays import Refused
from spectrail.operators import decomposition, kernels, regression
from spectrail.operators import preprocess as pre
from spectrail.operators.factors import training_sets
from spectrail.plans import catalog
from spectrail.plans.models import Model
from spectrail.plans.pipeline import Node, Pipeline
from spectrail.sources import instruments, matlab, opus, workbook


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 12)) @ rng.normal(size=(12, 12)) + 4
    return x, x @ rng.normal(size=12)


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(*data))], "sample_idx bigint, x array<double>, y double").cache()


def matrix(df):
    return np.array([r.x for r in df.orderBy("sample_idx").collect()])


def test_saved_regression(spark, table, data, tmp_path):
    steps = [pre.SavGol(5, 2), pre.Autoscale(), pre.SelectVariables((0, 3, 4, 9))]
    df = table
    for s in steps:
        df = s.fit_transform(df)
    m, _ = training_sets(df.withColumn("fold", pre.F.lit(0)), ["y"])
    b = kernels.pls(m.x, m.y[:, 0], 2, m.n).coefficients()
    model = Model("regression", {"b": b, "x_mean": m.x_mean, "y_mean": m.y_mean}, steps, list(range(12)))
    model.save(spark, f"{tmp_path}/model")
    again = Model.load(spark, f"{tmp_path}/model")
    want = {r.sample_idx: r.p for r in regression.predict(df, b, m.x_mean, float(m.y_mean[0])).collect()}
    got = {r.sample_idx: r for r in again.apply(table).collect()}
    assert all(np.isclose(got[k].p, want[k]) for k in want) and got[3].x == data[0][3].tolist()
    raw, constant = again.coefficients()
    assert np.allclose(data[0] @ raw[:, 0] + constant[0], [want[k] for k in range(50)])
    folded, c = pre.folded_coefficients(steps, b, 12, float(m.y_mean[0] - m.x_mean @ b))
    assert np.allclose(folded, raw[:, 0]) and np.isclose(c, constant[0])
    with pytest.raises(Refused, match="Snv"):
        Model("regression", {"b": b, "x_mean": m.x_mean, "y_mean": m.y_mean}, [pre.Snv()]).coefficients()


def test_saved_components_score_a_stream(spark, table, tmp_path):
    model, mean = decomposition.fit_pca(table, 3)
    top = decomposition.limits(model, 0.05, new=True)
    Model("components", {"loadings": model.loadings, "eigenvalues": model.eigenvalues, "x_mean": mean, "limits": np.array([top["t2"], top["spe"]])}, [], list(range(12))).save(spark, f"{tmp_path}/pca")
    saved = Model.load(spark, f"{tmp_path}/pca")
    want = {r.sample_idx: (r.t2, r.spe) for r in decomposition.with_scores(table, model, mean).collect()}
    table.write.parquet(f"{tmp_path}/in")
    query = saved.apply(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.sample_idx: r for r in spark.table("scored").collect()}
    assert len(got) == 50 and all(np.allclose((got[k].t2, got[k].spe), want[k]) for k in want)
    assert all(got[k].flagged == (want[k][0] > top["t2"] or want[k][1] > top["spe"]) for k in want)


def test_saved_classes_and_refusals(spark, table, tmp_path):
    model = Model("classes", {"b": np.eye(12)[:, :3], "x_mean": np.zeros(12), "y_mean": np.zeros(3)}, classes=["p", "q", "r"])
    got = {r.sample_idx: r.predicted for r in model.apply(table).collect()}
    assert got == {r.sample_idx: "pqr"[int(np.argmax(r.x[:3]))] for r in table.collect()}
    with pytest.raises(Refused, match="y_mean"):
        Model("regression", {"b": np.zeros(1), "x_mean": np.zeros(1)})
    rows = [("manifest", json.dumps({"version": 99}), [], [])]
    spark.createDataFrame(rows, "name string, text string, shape array<int>, values array<double>").write.parquet(f"{tmp_path}/newer")
    with pytest.raises(Refused, match="version 99"):
        Model.load(spark, f"{tmp_path}/newer")


def book(rows, date_style=False):
    """A workbook with one sheet; text is shared, (number, 1) is a cell of the date style, ("=", v) a formula with its value."""
    said, cells = [], []
    for i, row in enumerate(rows, 1):
        out = ""
        for j, v in enumerate(row):
            at = f'{chr(65 + j)}{i}'
            if v is None:
                continue
            if isinstance(v, str):
                said.append(v)
                out += f'<c r="{at}" t="s"><v>{len(said) - 1}</v></c>'
            elif isinstance(v, tuple) and v[0] == "=":
                out += f'<c r="{at}"><f>A1</f><v>{v[1]}</v></c>'
            elif isinstance(v, tuple):
                out += f'<c r="{at}" s="1"><v>{v[0]}</v></c>'
            else:
                out += f'<c r="{at}"><v>{v}</v></c>'
        cells.append(f'<row r="{i}">{out}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{t}</t></si>' for t in said)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return body.getvalue()


def test_workbook(spark, tmp_path):
    head = ["name", "1000", "1010", "1020", "protein", "day"]
    content = book([["made by hand"], [None], head, *[[f"s{k}", 0.1 * k, ("=", 0.2), 0.3, 10 + k, (45000 + k, 1)] for k in range(4)]])
    assert workbook.cells(content)[:2] == [head, ["s0", "0.0", "0.2", "0.3", "10", "2023-03-15"]]
    for name in ("a.xlsx", "b.xlsx"):
        (tmp_path / name).write_bytes(content)
    rows = workbook.read(spark, str(tmp_path)).orderBy("file", "sample_idx").collect()
    assert len(rows) == 8 and rows[1].x == [0.1, 0.2, 0.3] and rows[1].sample_id == "s1" and rows[1].t_protein == 11 and rows[1].m_day == "2023-03-16"
    with pytest.raises(Refused, match="no sheet"):
        workbook.cells(content, "Other")
    assert instruments.read_any(spark, str(tmp_path)).count() == 8
    hashes = {r.sha256 for r in instruments.content_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {hashlib.sha256(content).hexdigest()}


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def level_5(named, compress):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, v in named.items():
        v = np.atleast_2d(v)
        small = struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(v.shape, "<i4").tobytes()) + small + element(9, v.astype("<f8").tobytes(order="F"))
        whole = element(14, body)
        out += element(15, zlib.compress(whole))[: 8 + len(zlib.compress(whole))] if compress else whole
    return out


@pytest.mark.parametrize("compress", [False, True])
def test_matlab(spark, tmp_path, compress):
    x, axis, y = np.arange(12.0).reshape(4, 3), np.array([900.0, 950, 1000]), np.array([3.0, 1, 2, 5])
    (tmp_path / "a.mat").write_bytes(level_5({"spec": x, "axis_nm": axis, "fat": y[:, None]}, compress))
    (tmp_path / "b.mat").write_bytes(level_5({"spec": x.T, "axis_nm": axis, "fat": y}, compress))
    rows = matlab.read(spark, str(tmp_path)).orderBy("file", "sample_idx").collect()
    assert len(rows) == 8 and all(r.x == x[r.sample_idx].tolist() and r.axis == axis.tolist() and r.targets == {"fat": y[r.sample_idx]} for r in rows)


def test_matlab_level_4_and_refusals():
    x = np.arange(6.0).reshape(2, 3)
    content = struct.pack("<5I", 0, 2, 3, 0, 2) + b"x\0" + x.astype("<f8").tobytes(order="F")
    assert np.array_equal(matlab.arrays(content)["x"], x)
    for bad, what in ((b"\x89HDF\r\n\x1a\n" + b"\0" * 600, "7.3"), (b"no matlab file at all, " * 3, "level 4 or 5")):
        with pytest.raises(Refused, match=what):
            matlab.arrays(bad)
    with pytest.raises(Refused, match="no matrix"):
        matlab.chosen({"v": np.ones((1, 5))})


def test_baselines(table, data):
    x = data[0]
    d = np.diff(np.eye(12), 2, axis=0)
    got = matrix(pre.Baseline("asls", lam=50.0, p=0.1).transform(table))
    for row, left in zip(x, got, strict=True):
        w = np.ones(12)
        for _ in range(20):
            z = np.linalg.solve(np.diag(w) + 50.0 * d.T @ d, w * row)
            new = np.where(row > z, 0.1, 0.9)
            if np.array_equal(new, w):
                break
            w = new
        assert np.allclose(left, row - z, atol=1e-8)
    under = matrix(pre.Baseline("rubberband").transform(table))
    assert under.min() > -1e-9 and np.allclose(under[:, [0, -1]], 0)
    for k in range(50):  # the hull is the largest convex function below the row
        want = [min((x[k, i] * (j - m) + x[k, j] * (m - i)) / (j - i) if i < j else x[k, i] for i in range(m + 1) for j in range(m, 12)) for m in range(12)]
        assert np.allclose(x[k] - under[k], want)
    smooth = matrix(pre.Whittaker(30.0).transform(table))
    assert np.allclose(smooth @ (np.eye(12) + 30.0 * d.T @ d), x)


def test_spec_round_trip(table):
    for step in (pre.Msc().fit(table), pre.Autoscale(0).fit(table), pre.SavGol(7, 3, 1), pre.Baseline("polynomial", order=1), pre.SelectVariables((1, 5))):
        assert np.allclose(matrix(pre.from_spec(json.loads(json.dumps(pre.to_spec(step)))).transform(table)), matrix(step.transform(table)))


def test_catalog(spark, table, tmp_path):
    at = f"{tmp_path}"
    catalog.append(spark.createDataFrame([("a", "one"), ("b", "two")], "dataset_id string, name string"), at, "datasets")
    for k in (2, 1):
        catalog.append(spark.createDataFrame([("a", k, f"v{k}")], "dataset_id string, version int, version_id string"), at, "versions")
    got = {r.dataset_id: r.versions for r in catalog.versions_of(spark.read.parquet(f"{at}/datasets"), spark.read.parquet(f"{at}/versions")).collect()}
    assert [v.version_id for v in got["a"]] == ["v1", "v2"] and got["b"] is None
    p = Pipeline((Node.of("in", "source"), Node.of("s", "snv", "in")))
    stored = catalog.stored_matrix(pre.Snv().transform(table), p, "s", "v1", at)
    folder = stored.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert stored.count() == 50 and catalog.stored_matrix(table.limit(1), p, "s", "v1", at).count() == 50
    import os

    os.remove(f"{folder}/_SUCCESS")  # what a job leaves that was lost half-way
    assert catalog.stored_matrix(table.limit(7), p, "s", "v1", at).count() == 7


def opus_file(blocks, name="soil 1", drift=0.0):
    """blocks: (kind, channel, extra, values, scale)."""

    def parameter(key, kind, value):
        value += b"\0" * (len(value) % 2)
        return key.encode() + b"\0" + struct.pack("<hh", kind, len(value) // 2) + value

    bodies = [(160, 0, 0, parameter("SNM", 2, name.encode() + b"\0") + b"END\0" + bytes(4))]
    for kind, channel, extra, values, scale in blocks:
        bodies.append((kind, channel, extra, np.array(values, "<f4").tobytes() + bytes(8)))
        described = parameter("NPT", 0, struct.pack("<i", len(values))) + parameter("FXV", 1, struct.pack("<d", 4000 + drift)) + parameter("LXV", 1, struct.pack("<d", 3990 + drift)) + parameter("CSF", 1, struct.pack("<d", scale))
        bodies.append((kind + 16, channel, extra, described + b"END\0" + bytes(4)))
    head, at, entries, data = opus.MAGIC + struct.pack("<diii", 920622.0, 24, 40, len(bodies)), 24 + 12 * 40, b"", b""
    for kind, channel, extra, body in bodies:
        body += bytes(-len(body) % 4)
        entries += struct.pack("<4Bii", kind, channel, 0, extra, len(body) // 4, at + len(data))
        data += body
    return head + entries.ljust(12 * 40, b"\0") + data


def test_opus(spark, tmp_path):
    (tmp_path / "a.0").write_bytes(opus_file([(7, 4, 0, [9, 9, 9], 1.0), (15, 16, 64, [1, 2, 3], 1.0), (15, 16, 0, [2, 4, 6], 0.5)]))
    (tmp_path / "b.1").write_bytes(opus_file([(15, 16, 64, [5, 6, 7], 2.0)], "soil 2", 0.3))
    rows = instruments.aligned(instruments.read(spark, str(tmp_path))).orderBy("file").collect()
    assert [r.x for r in rows] == [[1, 2, 3], [10, 12, 14]] and all(r.axis == [4000, 3995, 3990] for r in rows) and [r.title for r in rows] == ["soil 1", "soil 2"]
    content = (tmp_path / "a.0").read_bytes()
    assert next(opus.opus(content, "ScSm"))[2].tolist() == [9, 9, 9]
    for bad, block, what in ((content, "Refl", "no block"), (b"abcd" + content[4:], None, "not an OPUS"), (opus_file([]), None, "no block")):
        with pytest.raises(Refused, match=what):
            next(opus.opus(bad, block))
    (tmp_path / "c.2").write_bytes(opus_file([(15, 16, 64, [5, 6, 7], 2.0)], drift=6.0))
    with pytest.raises(Exception, match="c.2: its axis"):
        instruments.aligned(instruments.read(spark, str(tmp_path))).collect()
