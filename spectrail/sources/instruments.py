"""Instrument files read as binaryFile, one task a file: JCAMP-DX, Galactic SPC and ASD."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

#: ASDF digits (fixed values of the JCAMP-DX format): squeezed, difference and repeat forms.
_SQZ = {c: d for d, (p, m) in enumerate(zip("@ABCDEFGHI", "@abcdefghi", strict=True)) for c, d in ((p, d), (m, -d))}
_DIF = {c: d for d, (p, m) in enumerate(zip("%JKLMNOPQR", "%jklmnopqr", strict=True)) for c, d in ((p, d), (m, -d))}
_DUP = {c: d for d, c in enumerate("STUVWXYZ", 1)} | {"s": 9}
_TOKEN = re.compile(r"([@A-Ia-i%J-Rj-rS-Zs]|[+-])?(\d*\.?\d*(?:[Ee][+-]?\d+(?=[\s,;]|$))?)")

Spectrum = tuple[str, np.ndarray, np.ndarray]


def _line(text: str) -> tuple[float, list[float], bool]:
    """X and the ordinates of one data line; whether the last came by difference."""
    head = re.match(r"\s*([+-]?\d+\.?\d*(?:[Ee][+-]?\d+)?)", text)
    if not head:
        raise Refused(f"no abscissa in line {text[:30]!r}")
    values: list[float] = []
    step, by_step = 0.0, False
    for m in _TOKEN.finditer(text, head.end()):
        lead, digits = m.group(1) or "", m.group(2)
        if not lead and not digits:
            continue
        if lead in _DUP:
            for _ in range(int(f"{_DUP[lead]}{digits}") - 1):
                values.append(values[-1] + step if by_step else values[-1])
        elif lead in _DIF:
            d = _DIF[lead]
            step, by_step = (-1 if d < 0 else 1) * float(f"{abs(d)}{digits}"), True
            values.append(values[-1] + step)
        else:
            d = _SQZ.get(lead)
            values.append(float(f"{lead}{digits}") if d is None else (-1 if d < 0 else 1) * float(f"{abs(d)}{digits}"))
            step, by_step = 0.0, False
    return float(head.group(1)), values, by_step


def jcamp(content: bytes) -> Iterator[Spectrum]:
    """Every block with (X++(Y..Y)) or (XY..XY) data; peak tables and NTUPLES are refused."""
    fields: dict[str, str] = {}
    for label, value in re.findall(r"##([^=]*)=(.*?)(?=\n\s*##|\Z)", re.sub(r"\$\$[^\n]*", "", content.decode("latin-1")), re.S):
        label = re.sub(r"[\s\-_/]", "", label).upper()
        if label in ("PEAKTABLE", "NTUPLES"):
            raise Refused(f"{label} isn't read")
        if label == "TITLE":
            fields = {}
        fields[label] = value.strip()
        if label in ("XYDATA", "XYPOINTS"):
            form, _, body = value.strip().partition("\n")
            fx, fy = float(fields.get("XFACTOR", 1)), float(fields.get("YFACTOR", 1))
            if "XY..XY" in form:
                pairs = np.array([float(v) for v in re.findall(r"[+-]?\d+\.?\d*(?:[Ee][+-]?\d+)?", body)]).reshape(-1, 2)
                x, y = pairs[:, 0] * fx, pairs[:, 1] * fy
            else:
                y_all: list[float] = []
                check = False
                for line in filter(str.strip, body.split("\n")):
                    _, values, by_step = _line(line)
                    if check:
                        if not values or values[0] != y_all[-1]:
                            raise Refused(f"the check ordinate of line {line[:20]!r} doesn't repeat the last one")
                        values = values[1:]
                    y_all += values
                    check = by_step
                y = np.array(y_all) * fy
                x = np.linspace(float(fields["FIRSTX"]), float(fields["LASTX"]), len(y))
            if "NPOINTS" in fields and int(float(fields["NPOINTS"])) != len(y):
                raise Refused(f"{len(y)} points where NPOINTS says {fields['NPOINTS']}")
            yield fields.get("TITLE", ""), x, y


def spc(content: bytes) -> Iterator[Spectrum]:
    """Files of the new format with even or shared x, and of the old one; one spectrum or many."""
    flags, version = content[0], content[1]
    if version == 0x4D:
        yield from _old_spc(content, bool(flags & 0x01), bool(flags & 0x04))
        return
    if version != 0x4B:
        raise Refused("big-endian SPC files aren't read" if version == 0x4C else f"SPC version {version:#x} isn't read")
    if flags & 0x40:
        raise Refused("files with an x array for each spectrum aren't read")
    exponent, points = struct.unpack_from("<b", content, 3)[0], struct.unpack_from("<i", content, 4)[0]
    first, last, count = struct.unpack_from("<ddi", content, 8)
    at = 512
    x = np.linspace(first, last, points)
    if flags & 0x80:
        x = np.frombuffer(content, "<f4", points, at).astype(float)
        at += 4 * points
    for k in range(max(1, count)):
        own = struct.unpack_from("<b", content, at + 1)[0] if flags & 0x04 else exponent
        at += 32
        if own == -128:
            y, size = np.frombuffer(content, "<f4", points, at).astype(float), 4
        elif flags & 0x01:
            y, size = np.frombuffer(content, "<i2", points, at) * 2.0 ** (own - 16), 2
        else:
            y, size = np.frombuffer(content, "<i4", points, at) * 2.0 ** (own - 32), 4
        at += size * points
        yield str(k), x, y


def _old_spc(content: bytes, short: bool, many: bool) -> Iterator[Spectrum]:
    """The old format: even x, a header of 256 bytes of which the last 32 are the first spectrum's own, as many spectra as the file has room for.

    Integers are two words of 16 bits, the high one first, or a single word;
    either way a fraction, times two to the exponent: the file's, or, where
    there are many spectra, each one's own.
    """
    exponent, points, first, last = struct.unpack_from("<hfff", content, 2)
    points, unit = int(points), "<i2" if short else "<u2"
    size = 32 + points * (2 if short else 4)
    room = (len(content) - 224) // size if points > 0 else 0
    if room < 1:
        raise Refused(f"an old SPC file of {len(content)} bytes has no room for {points} points")
    for k in range(room if many else 1):
        start = 224 + k * size
        scale = struct.unpack_from("<b", content, start + 1)[0] if many else exponent
        words = np.frombuffer(content, unit, points * (1 if short else 2), start + 32)
        whole = words / 2.0**16 if short else np.ascontiguousarray(words.reshape(-1, 2)[:, ::-1]).view("<i4").ravel() / 2.0**32
        yield str(k), np.linspace(first, last, points), whole * 2.0**scale


def asd(content: bytes) -> Iterator[Spectrum]:
    """Reflectance is the spectrum over the white reference, where the file holds one."""
    if content[:3] not in (b"ASD", b"as2", b"as3", b"as4", b"as5", b"as6", b"as7", b"as8"):
        raise Refused("not an ASD file")
    first, step = struct.unpack_from("<ff", content, 191)
    form, channels = content[199], struct.unpack_from("<h", content, 204)[0]
    kind = {0: "<f4", 1: "<i4", 2: "<f8"}[form]
    y = np.frombuffer(content, kind, channels, 484).astype(float)
    yield "", first + step * np.arange(channels), y


FORMATS: dict[str, Callable[[bytes], Iterator[Spectrum]]] = {".jdx": jcamp, ".dx": jcamp, ".jcm": jcamp, ".spc": spc, ".asd": asd}


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, part, title, axis, x of every spectrum of the files under a path, by their suffix.  Number the rows with outliers.numbered."""
    from . import more_instruments, opus

    formats = dict(more_instruments.FORMATS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                suffix = "." + name.rsplit(".", 1)[-1].lower()
                parser = opus.opus if content[:4] == opus.MAGIC else formats.get(suffix)  # OPUS files end in a number
                if parser is None:
                    raise Refused(f"{name}: no reader for {suffix}")
                rows += [(name, k, title, axis.tolist(), y.tolist()) for k, (title, axis, y) in enumerate(parser(content))]
            yield pd.DataFrame(rows, columns=["file", "part", "title", "axis", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, part int, title string, axis array<double>, x array<double>")


def aligned(spectra: DataFrame) -> DataFrame:
    """The spectra on the axis of the first file and part.

    Instruments drift by parts of a point between measurements; a spectrum of
    another number of points, or whose axis lies more than one point spacing
    off at either end, is another measurement and is refused by name.
    """
    first = spectra.orderBy("file", "part").select("axis").first()
    if first is None:
        raise Refused("no spectra")
    axis = first["axis"]
    step = abs(axis[1] - axis[0]) if len(axis) > 1 else 0.0
    off = F.greatest(F.abs(F.get("axis", F.lit(0)) - axis[0]), F.abs(F.get("axis", F.size("axis") - 1) - axis[-1]))
    bad = (F.size("axis") != len(axis)) | (off > step * (1 + 1e-9))
    said = F.raise_error(F.concat(F.col("file"), F.lit(": its axis isn't that of the first file"))).cast("array<double>")
    return spectra.withColumn("x", F.when(bad, said).otherwise(F.col("x"))).withColumn("axis", F.array(*[F.lit(float(v)) for v in axis]))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256 (lowercase hex) of every file under a path: what two copies of a file agree in."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """The samples of the files under a path by the suffix of the first: tables (delimited text, workbooks), MATLAB matrices, or instrument files."""
    from . import delimited, matlab, workbook

    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first is None:
        raise Refused(f"{path} has no files")
    suffix = "." + first.rsplit(".", 1)[-1].lower()
    reader = {".csv": delimited.read, ".tsv": delimited.read, ".txt": delimited.read, ".xlsx": workbook.read, ".mat": matlab.read}.get(suffix, read)
    return reader(spark, path, **options)
