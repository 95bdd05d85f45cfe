"""``spark.read.format("spectra")`` and ``readStream``: a partition a file or a member of an archive, by format.

Files are listed and opened through Arrow's file systems (local paths and the
addresses that Arrow knows, such as hdfs:// and s3://).  Of an archive only the
directory is read where files are listed, and each task reads its own member.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spectrail.functions.arrays import Refused

from . import delimited, more_instruments, opus

SCHEMA = "file string, member string, part int, title string, axis array<double>, x array<double>, more map<string,string>"
TABLES = (".csv", ".tsv", ".txt")
#: Lines of a table from which its layout is guessed.
SNIFFED = 50


@dataclass
class Place(InputPartition):
    """A file, or one member of an archive."""

    path: str
    member: str | None


def _suffix(name: str) -> str:
    return "." + name.rsplit(".", 1)[-1].lower()


def _opened(path: str):
    """A file system and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(path: str, recursive: bool) -> list[pafs.FileInfo]:
    """The files under a path, by name; those that start with . or _ aren't data."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type == pafs.FileType.NotFound:
        raise Refused(f"{path} doesn't exist")
    found = system.get_file_info(pafs.FileSelector(at, recursive=recursive))
    return sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def _places(path: str, files: list[pafs.FileInfo]) -> list[Place]:
    """A place a file; archives are opened for their directories."""
    system, out = _opened(path)[0], []
    for f in files:
        if _suffix(f.path) != ".zip":
            out.append(Place(f.path, None))
            continue
        with system.open_input_file(f.path) as held, zipfile.ZipFile(held) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if not info.is_dir():
                    if info.file_size > more_instruments.MEMBER_BYTES:
                        raise Refused(f"{f.path}: {info.filename} has {info.file_size} bytes")
                    out.append(Place(f.path, info.filename))
    return out


def _table(lines: Iterator[str], name: str) -> Iterator[tuple[int, str, list[float], list[float], dict[str, str]]]:
    """The samples of delimited text, line by line; its layout comes from the first lines."""
    rows = (line for line in (x.rstrip("\r\n") for x in lines) if line.strip())
    first = list(islice(rows, SNIFFED))
    if not first:
        raise Refused(f"{name} is empty")
    first[0] = first[0].removeprefix("﻿")
    layout = delimited.guessed(first, name)
    if layout.transposed:
        raise Refused(f"{name} has samples in columns; read it with delimited.read")
    place = {h: k for k, h in enumerate(layout.header)}
    titled = list(layout.header) == delimited._cells(first[0], layout.delimiter)
    for k, line in enumerate([*first[int(titled) :]]):
        yield _sample(k, line, layout, place, name)
    for k, line in enumerate(rows, len(first) - int(titled)):
        yield _sample(k, line, layout, place, name)


def _sample(k: int, line: str, layout: delimited.Layout, place: dict[str, int], name: str):
    cells = delimited._cells(line, layout.delimiter)
    if len(cells) != len(layout.header):
        raise Refused(f"{name}, sample {k}: wrong number of cells")
    x = [delimited._number(cells[place[h]], layout.decimal_comma) for h in layout.spectrum]
    if None in x:
        raise Refused(f"{name}, sample {k}: column {layout.spectrum[x.index(None)]} is not a number")
    title = cells[place[layout.ids]] if layout.ids else f"S{k + 1:04d}"
    return k, title, list(layout.axis), x, {h: cells[place[h]] for h in (*layout.targets, *layout.metadata)}


def _rows(path: str, place: Place) -> Iterator[tuple]:
    system = _opened(path)[0]
    name = place.member or place.path
    with system.open_input_file(place.path) as held:
        if place.member is not None:
            with zipfile.ZipFile(held) as z, z.open(place.member) as inside:
                yield from _parsed(place, name, inside)
        else:
            yield from _parsed(place, name, held)


def _parsed(place: Place, name: str, held) -> Iterator[tuple]:
    if _suffix(name) in TABLES:
        for k, title, axis, x, more in _table(io.TextIOWrapper(held, "utf-8-sig"), name):
            yield place.path, place.member, k, title, axis, x, more
        return
    content = held.read()
    parser = opus.opus if content[:4] == opus.MAGIC else more_instruments.FORMATS.get(_suffix(name))
    if parser is None or _suffix(name) == ".zip":
        raise Refused(f"{name}: no reader for {_suffix(name)}")
    for k, (title, axis, y) in enumerate(parser(content)):
        yield place.path, place.member, k, title, axis.tolist(), y.tolist(), {}


class _Batch(DataSourceReader):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive

    def partitions(self) -> list[Place]:
        return _places(self.path, _listed(self.path, self.recursive))

    def read(self, partition: Place) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the time and name of the newest file read; files must come into the folder whole and with a new time, as by a move."""

    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive

    def _after(self, start: dict, end: dict) -> list[pafs.FileInfo]:
        return [f for f in _listed(self.path, self.recursive) if (start["time"], start["file"]) < (f.mtime_ns, f.path) <= (end["time"], end["file"])]

    def initialOffset(self) -> dict:
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.mtime_ns, f.path) for f in _listed(self.path, self.recursive)), default=(0, ""))
        return {"time": newest[0], "file": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Place]:
        return _places(self.path, self._after(start, end))

    def read(self, partition: Place) -> Iterator[tuple]:
        return _rows(self.path, partition)


class SpectraSource(DataSource):
    """Options: path, and recursive (true or false, false by default)."""

    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, bool]:
        if "path" not in self.options:
            raise Refused("the format spectra needs a path")
        return self.options["path"], self.options.get("recursive", "false").lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._where())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._where())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SpectraSource)
