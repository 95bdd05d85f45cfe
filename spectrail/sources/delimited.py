"""Delimited spectra: the layout is guessed from the first lines on the driver, the rows are read by Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_COMMA_NUMBER = re.compile(r"[+-]?\d+,\d+")
_SPACE = r"\s+"


@dataclass(frozen=True)
class Layout:
    """What was guessed, and may be corrected before reading."""

    delimiter: str
    decimal_comma: bool
    header: tuple[str, ...]
    ids: str | None
    axis: tuple[float, ...]
    spectrum: tuple[str, ...]
    targets: tuple[str, ...]
    metadata: tuple[str, ...]
    transposed: bool = False
    alternatives: dict[str, list] = field(default_factory=dict, hash=False, compare=False)

    @property
    def axis_kind(self) -> str:
        steps = [b - a for a, b in zip(self.axis, self.axis[1:], strict=False)]
        if not steps or not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
            return "index"
        return "wavenumber_cm-1" if steps[0] < 0 or self.axis[-1] > 3000 else "wavelength_nm"

    def corrected(self, **changes) -> Layout:
        """A layout with other choices; only those offered are taken."""
        for name, value in changes.items():
            if value not in self.alternatives.get(name, []):
                raise Refused(f"{name} can't be {value!r}; offered: {self.alternatives.get(name, [])}")
        return replace(self, **changes)


def _cells(line: str, delimiter: str) -> list[str]:
    return [c.strip() for c in (line.split() if delimiter == _SPACE else line.split(delimiter))]


def _number(cell: str, comma: bool) -> float | None:
    cell = cell.replace(",", ".") if comma else cell
    return float(cell) if _NUMBER.fullmatch(cell) else None


def sniff(spark: SparkSession, path: str) -> Layout:
    """The layout from the first 50 lines that aren't empty."""
    lines = [r.value for r in spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(50).collect()]
    if not lines:
        raise Refused(f"{path} is empty")
    lines[0] = lines[0].removeprefix("﻿")
    return guessed(lines, path)


def guessed(lines: list[str], path: str) -> Layout:
    """The layout of the first lines of a table, none of them empty."""
    fits = {}
    for d in (",", ";", "\t", "|", _SPACE):
        sizes = [len(_cells(x, d)) for x in lines]
        if max(sizes) > 1:
            most = max(set(sizes), key=lambda n: (sizes.count(n), n))
            fits[d] = (sizes.count(most), most)
    if not fits:
        raise Refused(f"{path}: no delimiter splits its lines")
    delimiter = max(fits, key=fits.get)
    table = [_cells(x, delimiter) for x in lines]
    flat = [c for row in table for c in row]
    comma = delimiter != "," and sum(bool(_COMMA_NUMBER.fullmatch(c)) for c in flat) > sum("." in c and bool(_NUMBER.fullmatch(c)) for c in flat)
    return layout_of(table, delimiter, comma, path, list(fits))


def layout_of(table: list[list[str]], delimiter: str, comma: bool, path: str, fits: list[str] | None = None) -> Layout:
    """The layout of the first rows of a table of cells."""
    if not table:
        raise Refused(f"{path} is empty")
    fits = fits or [delimiter]
    number = lambda c: _number(c, comma)
    titled = any(number(c) is None for c in table[0])
    header = table[0] if titled else [str(k) for k in range(len(table[0]))]
    body = table[1:] if titled else table
    if not body:
        raise Refused(f"{path} has no rows below its header")
    for k, row in enumerate(body):
        if len(row) != len(header):
            raise Refused(f"{path}, line {k + 1 + titled}: {len(row)} cells where {len(header)} are expected")
    column = lambda k: [row[k] for row in body]
    numeric = [all(number(c) is not None for c in column(k)) for k in range(len(header))]
    first = [number(c) for c in column(0)]
    steps = [b - a for a, b in zip(first, first[1:], strict=False)] if numeric[0] else []
    transposed = titled and numeric[0] and len(body) >= 3 and all(number(h) is None for h in header[1:]) and (all(s > 0 for s in steps) or all(s < 0 for s in steps))
    if transposed:
        return Layout(delimiter, comma, tuple(header), None, tuple(first), tuple(header[1:]), (), (), True, {"transposed": [True, False]})
    named = [number(h) is not None for h in header]
    ids = header[0] if titled and not named[0] and len(set(column(0))) == len(body) else None
    spectrum = [h for h, n, v in zip(header, named, numeric, strict=True) if v and (n or not any(named)) and h != ids]
    targets = [h for h, n, v in zip(header, named, numeric, strict=True) if v and not n and any(named) and h != ids]
    metadata = [h for h, v in zip(header, numeric, strict=True) if not v and h != ids and any(column(header.index(h)))]
    if not spectrum:
        raise Refused(f"{path} has no spectrum columns")
    axis = tuple(number(h) if number(h) is not None else float(k) for k, h in enumerate(spectrum))
    return Layout(delimiter, comma, tuple(header), ids, axis, tuple(spectrum), tuple(targets), tuple(metadata), False, {"ids": [ids, None], "delimiter": fits})


def read(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """sample_idx (in file order), sample_id, x, a t_ column for each target and an m_ column for each text.

    Every line must have the header's width and numbers where the layout has
    them; the first that hasn't is named.
    """
    layout = layout or sniff(spark, path)
    sep = layout.delimiter if layout.delimiter == _SPACE else re.escape(layout.delimiter)
    placed = numbered_lines(spark, path)
    return laid_out(placed.select("line", F.split(F.trim(F.regexp_replace("value", "^\ufeff", "")), sep).alias("c")), layout)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: the lines that aren't blank, numbered from 0 by file, then place.

    A task reads a stretch of a file from front to back, so a line's place in it
    is how far its running number is from the stretch's least; the lines of the
    stretches before give the rest.  There is one row a stretch to add up.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    text = text.where(F.length(F.trim("value")) > 0).withColumn("running", F.monotonically_increasing_id())
    stretches = text.groupBy("file", "at").agg(F.min("running").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = stretches.select("file", "at", (before - F.col("least")).alias("shift"))
    return text.join(F.broadcast(known), ["file", "at"]).select((F.col("running") + F.col("shift")).alias("line"), "value")


def preview(spark: SparkSession, path: str, rows: int = 20, layout: Layout | None = None) -> tuple[Layout, list[list[str]]]:
    """The layout, and the cells of the first lines that aren't empty, the header included."""
    layout = layout or sniff(spark, path)
    lines = [r.value for r in spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(rows).collect()]
    return layout, [_cells(x.removeprefix("\ufeff"), layout.delimiter) for x in lines]


def laid_out(placed: DataFrame, layout: Layout, *keep: str) -> DataFrame:
    """The samples of rows of cells (``line`` from 0, ``c``, and columns to keep) in a layout."""
    titled = not all(h == str(k) for k, h in enumerate(layout.header))
    rows = placed.where(F.col("line") > 0) if titled else placed
    checked = F.when(F.size("c") != len(layout.header), F.raise_error(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(": wrong number of cells")))).otherwise(F.col("c"))
    rows = rows.select(*keep, (F.col("line") - int(titled)).alias("sample_idx"), F.transform(checked, lambda c: F.trim(c)).alias("c"))

    def number(h: str):
        cell = F.get("c", F.lit(layout.header.index(h)))
        value = F.regexp_replace(cell, ",", ".") if layout.decimal_comma else cell
        return F.coalesce(value.try_cast("double"), F.raise_error(F.concat(F.lit(f"column {h}, sample "), F.col("sample_idx").cast("string"), F.lit(": not a number"))).cast("double"))

    if layout.transposed:
        long = rows.select(*keep, F.col("sample_idx").alias("k"), F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("sample_idx"), F.lit(h).alias("sample_id"), number(h).alias("v")) for i, h in enumerate(layout.spectrum)])).alias("s"))
        return long.groupBy(*keep, "s.sample_idx", "s.sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s.v"))), lambda z: z["v"]).alias("x"))
    ids = F.get("c", F.lit(layout.header.index(layout.ids))) if layout.ids else F.concat(F.lit("S"), F.lpad((F.col("sample_idx") + 1).cast("string"), 4, "0"))
    return rows.select(
        *keep,
        "sample_idx",
        ids.alias("sample_id"),
        F.array(*[number(h) for h in layout.spectrum]).alias("x"),
        *[number(h).alias(f"t_{h}") for h in layout.targets],
        *[F.get("c", F.lit(layout.header.index(h))).alias(f"m_{h}") for h in layout.metadata],
    )
