"""Readers, pipelines and streaming."""

import struct

import numpy as np
import pytest

from spectrail.functions.arrays import Refused
from spectrail.operators import decomposition
from spectrail.plans.pipeline import Node, Pipeline, difference
from spectrail.sources import delimited, instruments
from spectrail.streaming.scoring import flag_rate, monitored

VALUES = [[1.5, 2.25, 3.0], [4.0, 5.5, 6.125]]


def test_delimited_layouts_agree(spark, tmp_path):
    files = {
        "a.csv": "sample,850,860,870,fat\nA,1.5,2.25,3.0,7.5\nB,4.0,5.5,6.125,8.5\n",
        "b.csv": "sample;batch;850;860;870;fat\nA;x;1,5;2,25;3,0;7,5\nB;y;4,0;5,5;6,125;8,5\n",
        "c.csv": "wavelength,A,B\n850,1.5,4.0\n860,2.25,5.5\n870,3.0,6.125\n",
        "d.txt": "1.5 2.25 3.0\n4.0 5.5 6.125\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        layout = delimited.sniff(spark, str(tmp_path / name))
        rows = delimited.read(spark, str(tmp_path / name), layout).orderBy("sample_idx").collect()
        assert [r.x for r in rows] == VALUES, name
        assert name == "d.txt" or layout.axis == (850, 860, 870) and layout.axis_kind == "wavelength_nm" and [r.sample_id for r in rows] == ["A", "B"]
    assert [r.t_fat for r in delimited.read(spark, str(tmp_path / "a.csv")).orderBy("sample_idx").collect()] == [7.5, 8.5]
    with pytest.raises(Refused):
        layout.corrected(delimiter="@")
    (tmp_path / "e.csv").write_text("s,1,2\nA,1,2\nB,1\n")
    with pytest.raises(Refused, match="line 3"):
        delimited.sniff(spark, str(tmp_path / "e.csv"))


def test_instruments(spark, tmp_path):
    (tmp_path / "a.jdx").write_text("##TITLE=one\n##FIRSTX=1\n##LASTX=5\n##YFACTOR=0.5\n##NPOINTS=5\n##XYDATA=(X++(Y..Y))\n1A00JKJ%\n##END=\n##TITLE=two\n##XYPOINTS=(XY..XY)\n1,2 3,4\n##END=\n")
    head = bytearray(512)
    head[1], head[3] = 0x4B, 0x80
    struct.pack_into("<i", head, 4, 3)
    struct.pack_into("<ddi", head, 8, 10.0, 30.0, 1)
    (tmp_path / "b.spc").write_bytes(bytes(head) + bytes(32) + np.array([1, 2, 4], "<f4").tobytes())
    body = bytearray(600)
    body[30:33] = b"spa"
    struct.pack_into("<BBii", body, 304, 2, 0, 400, 32)
    struct.pack_into("<BBii", body, 320, 3, 0, 500, 12)
    struct.pack_into("<i", body, 404, 3)
    struct.pack_into("<ff", body, 416, 4000.0, 3998.0)
    struct.pack_into("<fff", body, 500, 7.0, 8.0, 9.0)
    import zipfile

    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("two.spa", bytes(body))
        z.writestr("one.spc", bytes(head) + bytes(32) + np.array([5, 6, 7], "<f4").tobytes())
    rows = {(r.file.rsplit("/", 1)[-1], r.part): r for r in instruments.read(spark, str(tmp_path)).collect()}
    assert rows["a.jdx", 0].x == [50, 50.5, 51.5, 52, 52] and rows["a.jdx", 1].x == [2, 4]
    assert rows["b.spc", 0].axis == [10, 20, 30] and rows["b.spc", 0].x == [1, 2, 4]
    assert rows["c.zip", 0].x == [5, 6, 7] and rows["c.zip", 1].x == [7, 8, 9] and rows["c.zip", 1].axis == [4000, 3999, 3998] and rows["c.zip", 1].title == "spa"


def test_pipeline():
    nodes = (Node.of("s", "source"), Node.of("c", "mean_centre", "s"), Node.of("k", "kfold", "c", n_splits=5), Node.of("p", "pls", "k", n_components=3), Node.of("q", "mlr", "s"))
    p = Pipeline(nodes)
    assert [w[0] for w in p.warnings()] == ["c", "q"] and [n.id for n in p.descendants("c")] == ["k", "p"]
    assert not Pipeline((nodes[0], Node.of("q", "pca", "s"))).warnings()  # components centre by themselves
    other = Pipeline((*nodes[:2], Node.of("k", "kfold", "c", n_splits=4), nodes[3]))
    a, b = p.keys("v"), other.keys("v")
    assert a["c"] == b["c"] and a["k"] != b["k"] and a["p"] != b["p"] and p.state("v", {a["c"]})["p"] == "stale"
    assert difference(p, other) == {"c": "unchanged", "k": "changed", "p": "unchanged", "q": "removed", "s": "unchanged"}
    for bad in ((nodes[1],), (nodes[0], nodes[0]), (*nodes, Node.of("x", "snv", "p")), (*nodes, Node.of("x", "loo", "k")), (nodes[0], Node.of("a", "snv", "b"), Node.of("b", "snv", "a"))):
        with pytest.raises(Refused):
            Pipeline(bad)


def test_streaming(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * (9 if i == 30 else 1)).tolist()) for i in range(31)]
    table = spark.createDataFrame(rows, "sample_idx bigint, x array<double>").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(sample_idx as int)) ts")
    model, mean = decomposition.fit_pca(table.where("sample_idx < 30"), 2)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = monitored(stream, [], model, mean).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("flagged and sample_idx = 30").count() == 1 and flag_rate(spark.table("scored")).count() == 7
