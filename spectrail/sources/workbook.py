"""Tables in XLSX workbooks, a folder of files at once: cells as text, laid out as delimited files are."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

from . import delimited

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of built-in formats that show a date or a time (fixed values of the file format).
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """Of each cell style whether it shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    cells = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return [i in _DATES or bool(re.search("[ymdhs]", own.get(i, ""), re.I)) for i in ids]


def _iso(serial: float, since_1904: bool) -> str:
    at = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    at += datetime.timedelta(seconds=round(serial * 86400))
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat()


def cells(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """A sheet's cells as text (the first sheet unless one is named), formulas by the value stored with them.

    Rows of fewer than two cells at the head, empty rows and empty columns are
    left out; numbers keep the digits they are stored with; dates are ISO.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        listed = {s.get("name"): s.get(f"{_REL}id") for s in book.iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in listed:
            raise Refused(f"no sheet {sheet}; there are {', '.join(listed)}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[listed[sheet] if sheet is not None else next(iter(listed.values()))]
        said = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        dates = _date_styles(z)
        since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
        rows: list[dict[int, str]] = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            here: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at, kind = _column(c.get("r")) if c.get("r") else k, c.get("t", "n")
                value = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
                if kind == "s" and text:
                    text = said[int(text)]
                elif kind == "b" and text:
                    text = "true" if text == "1" else "false"
                elif kind == "n" and text and (style := int(c.get("s", 0))) < len(dates) and dates[style]:
                    text = _iso(float(text), since_1904)
                if text.strip():
                    here[at] = text.strip()
            rows.append(here)
    while rows and len(rows[0]) < 2:
        rows.pop(0)
    rows = [r for r in rows if r]
    columns = sorted(set().union(*rows)) if rows else []
    return [[r.get(k, "") for k in columns] for r in rows]


def read(spark: SparkSession, path: str, sheet: str | None = None, layout: delimited.Layout | None = None) -> DataFrame:
    """file, and the columns of delimited.read, of every workbook under a path; sample_idx counts within a file.

    The layout, unless given, is that of the first file by name; a file of
    another width is refused.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    table = cells(content, sheet)
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as wrong:
                    raise Refused(f"{name}: not a workbook ({wrong})") from None
                yield pd.DataFrame({"file": name, "line": range(len(table)), "c": table}, columns=["file", "line", "c"])

    rows = files.mapInPandas(parse, "file string, line bigint, c array<string>")
    if layout is None:
        first = rows.agg(F.min("file")).first()[0]
        if first is None:
            raise Refused(f"{path} has no rows")
        layout = delimited.layout_of([r.c for r in rows.where((F.col("file") == first) & (F.col("line") < 50)).orderBy("line").collect()], ",", False, path)
    return delimited.laid_out(rows, layout, "file")
