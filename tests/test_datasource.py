"""The format spectra in batches and streams, line numbers of split files, old SPC files."""

import struct
import zipfile

import numpy as np
import pytest

from spectrail.sources import datasource, delimited, instruments

RNG = np.random.default_rng(4)


def new_spc(values):
    head = bytearray(512)
    head[1], head[3] = 0x4B, 0x80
    struct.pack_into("<i", head, 4, len(values))
    struct.pack_into("<ddi", head, 8, 10.0, 30.0, 1)
    return bytes(head) + bytes(32) + np.array(values, "<f4").tobytes()


def old_spc(rows, exponents, short=False, many=False, file_exponent=0):
    """Written by the format's description: high words first."""
    head = bytearray(224)
    head[0], head[1] = (1 if short else 0) | (4 if many else 0), 0x4D
    struct.pack_into("<hfff", head, 2, file_exponent, float(len(rows[0])), 100.0, 200.0)
    out = bytes(head)
    for row, e in zip(rows, exponents, strict=True):
        sub = bytearray(32)
        struct.pack_into("<b", sub, 1, e)
        scale = e if many else file_exponent
        whole = [round(v / 2.0**scale * 2 ** (16 if short else 32)) for v in row]
        out += bytes(sub) + b"".join(struct.pack("<h", n) if short else struct.pack("<HH", (n >> 16) & 0xFFFF, n & 0xFFFF) for n in whole)
    return out


@pytest.mark.parametrize("short", [False, True])
def test_old_spc(short):
    rows = [[1.5, -2.25, 3.0, 0.0, -0.001], [7.0, 6.5, -5.0, 1e-3, 2.0]]
    near = 1e-8 if not short else 1e-3
    got = list(instruments.spc(old_spc(rows[:1], [0], short, False, 4)))
    assert len(got) == 1 and np.allclose(got[0][2], rows[0], atol=near) and np.allclose(got[0][1], np.linspace(100, 200, 5))
    many = list(instruments.spc(old_spc(rows, [3, 4], short, True)))
    assert [t for t, _, _ in many] == ["0", "1"] and np.allclose([y for _, _, y in many], rows, atol=near)
    with pytest.raises(Exception, match="no room"):
        list(instruments.spc(old_spc(rows[:1], [0], short, False, 4)[:250]))
    with pytest.raises(Exception, match="big-endian"):
        list(instruments.spc(bytes([0, 0x4C]) + bytes(600)))


@pytest.fixture()
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(40):
            z.writestr(f"in/m{k:02d}.spc", new_spc([k, k + 1, k + 2]))
        z.writestr("in/table.csv", "sample,850,860,fat,kind\nA,1.5,2.25,7.5,u\nB,4.0,5.5,8.5,v\n")
    (tmp_path / "one.spc").write_bytes(new_spc([5, 6, 7]))
    (tmp_path / "rows.txt").write_text("".join(f"{k};{k},5;{k},25;{k}\n" for k in range(120)))
    (tmp_path / "_hidden.spc").write_bytes(b"x")
    return tmp_path


def test_batches(spark, folder):
    datasource.register(spark)
    df = spark.read.format("spectra").load(str(folder))
    assert df.rdd.getNumPartitions() == 43
    rows = df.collect()
    of = {(r.file.rsplit("/", 1)[-1], r.member, r.part): r for r in rows}
    assert len(rows) == 40 + 2 + 1 + 120
    assert all(of["many.zip", f"in/m{k:02d}.spc", 0].x == [k, k + 1, k + 2] for k in range(40)) and of["one.spc", None, 0].axis == [10, 20, 30]
    b = of["many.zip", "in/table.csv", 1]
    assert (b.title, b.axis, b.x, b.more) == ("B", [850, 860], [4.0, 5.5], {"fat": "8.5", "kind": "v"})
    assert of["rows.txt", None, 119].x == [119, 119.5, 119.25, 119]
    assert spark.read.format("spectra").option("recursive", "true").load(str(folder / "one.spc")).count() == 1


def test_broken_files_are_named(spark, folder):
    datasource.register(spark)
    (folder / "short.csv").write_text("s,850,860\n" + "A,1,2\n" * 60 + "B,1\n")
    with pytest.raises(Exception, match="short.csv, sample 60"):
        spark.read.format("spectra").load(str(folder / "short.csv")).collect()
    (folder / "what.bin").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no reader for .bin"):
        spark.read.format("spectra").load(str(folder / "what.bin")).collect()
    with pytest.raises(Exception, match="doesn't exist"):
        spark.read.format("spectra").load(str(folder / "nowhere")).collect()


def test_streams(spark, folder, tmp_path_factory):
    datasource.register(spark)
    out, marks = tmp_path_factory.mktemp("out"), tmp_path_factory.mktemp("marks")

    def drained():
        stream = spark.readStream.format("spectra").load(str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.read.parquet(str(out))

    batch = spark.read.format("spectra").load(str(folder))
    key = lambda df: sorted((r.file, r.member or "", r.part, tuple(r.x)) for r in df.collect())
    assert key(drained()) == key(batch)
    (folder / "later.spc").write_bytes(new_spc([9, 9, 9]))
    got = drained()
    assert got.count() == 164 and got.where("x[0] = 9 and x[1] = 9").count() == 1


def test_lines_of_split_files(spark, tmp_path):
    """Files in many stretches, blank lines between, several files by name."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name in "ba":
            (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" + ("\n  \n" if k % 7 == 0 else "") for k in range(900)))
        got = delimited.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4
        assert [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate([f"{n}{k}" for n in "ab" for k in range(900)]))
        (tmp_path / "c.csv").write_text("s,1,2\n" + "".join(f"r{k},{k},{2 * k}\n" for k in range(500)))
        rows = delimited.read(spark, str(tmp_path / "c.csv")).orderBy("sample_idx").collect()
        assert [(r.sample_idx, r.sample_id, r.x) for r in rows] == [(k, f"r{k}", [k, 2 * k]) for k in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
