"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BLOBS, BUCKET, FLUSH, bucket_bits, bucketed, leads, planes, table, unpacked, unplanes
from .tables import small_batches
from .words import chunks, mix


def _search(window: int, bits: int):
    """Each task's windows by bucket of their hash; what repeats within a flush is settled there, so a hot window leaves once a flush."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        if (doc[1:] < doc[:-1]).any():
            order = np.lexsort((start, doc))
            h, doc, start = h[order], doc[order], start[order]
        order = np.argsort(h, kind="stable")
        lead = order[leads(h[order])]
        fresh = np.zeros(len(h), bool)
        fresh[lead] = True
        mine = order[order != lead]
        lead = lead[order != lead]
        known = np.sort(mine[(doc[mine] != doc[lead]) | (start[mine] != start[lead])])
        at = np.flatnonzero(fresh)
        rows = bucketed(h[at], bits, doc[at], start[at], True) + bucketed(h[known], bits, doc[known], start[known], False)
        for lo in range(0, len(rows), 1000):
            yield from table(rows[lo : lo + 1000]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                at, h = c.windows(window)
                if len(at):
                    parts.append((h, ids[c.row + c.doc[at]], (at - c.first[c.doc[at]]).astype(np.int32)))
                    held += len(at)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _later(doc_buckets: int):
    """Of one bucket's windows, those whose hash has an earlier place, by bucket of document."""

    def run(group: pa.Table) -> pa.Table:
        h, doc, start, known = [], [], [], []
        for row in group.to_pylist():
            d, s = unplanes(row["docs"], np.int64), unplanes(row["starts"], np.int32)
            if row["keys"]:
                h.append(unpacked(row["keys"]))
                doc.append(d)
                start.append(s)
            else:
                known.append((d, s))
        if h:
            h, doc, start = map(np.concatenate, (h, doc, start))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            many = np.zeros(len(h), bool)
            many[1:] |= same
            many[:-1] |= same
            x = order[many]
            x = x[np.lexsort((start[x], doc[x], h[x]))]
            lead = x[leads(h[x])]
            x = x[(doc[x] != doc[lead]) | (start[x] != start[lead])]
            known.append((doc[x], start[x]))
        doc, start = map(np.concatenate, zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        to = (mix(doc.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int64)  # ids may share a divisor
        order = np.lexsort((start, doc, to))
        doc, start, to = doc[order], start[order], to[order]
        edges = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else []
        rows = [(int(to[lo]), hi - lo, b"", planes(doc[lo:hi]), planes(start[lo:hi])) for lo, hi in zip(edges, [*edges[1:], len(to)], strict=False)]
        return table(rows)

    return run


_SPANS = pa.schema([("span_doc", pa.int64()), ("spans", pa.binary())])


def _merged(window: int):
    """Maximal intervals of words of each document from the starts of its repeated windows."""

    def run(group: pa.Table) -> pa.Table:
        doc = np.concatenate([unplanes(x, np.int64) for x in group.column("docs").to_pylist()])
        start = np.concatenate([unplanes(x, np.int32) for x in group.column("starts").to_pylist()])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(doc)) - 1
        span = np.stack([start[lo], start[hi] + window], 1).astype(np.int32)
        head = np.flatnonzero(np.diff(doc[lo], prepend=doc[lo][0] - 1))
        parts = [span[a:b].tobytes() for a, b in zip(head, [*head[1:], len(lo)], strict=True)]
        return pa.table([pa.array(doc[lo][head]), pa.array(parts, pa.binary())], schema=_SPANS)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            n, gone, kept = [], [], []
            for text, spans in zip(part.column(1), part.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if spans.is_valid:
                    left, at = [], 0
                    for a, b in np.frombuffer(spans.as_py(), np.int32).reshape(-1, 2).tolist():
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_removed, kept_text``.

    A window is ``window`` consecutive words; each word goes that is covered by
    a window whose sequence also starts earlier (smaller id, or same document
    and smaller start).  Windows are judged on the input.  ``kept_text`` has the
    kept words joined by one space.

    A null or empty text has no words; a text shorter than the window loses
    none.  A row with a null id neither removes nor loses words.  Rows that
    repeat an id count as one document: the same text twice keeps its words.
    Other columns, whatever their names, aren't read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a rough word has six bytes
    bits = bucket_bits(spark, size / 6)
    doc_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / (8 * BUCKET)))
    found = (
        rows.where("doc_id is not null and text is not null")
        .mapInArrow(_search(window, bits), BLOBS)
        .groupBy("bucket")
        .applyInArrow(_later(doc_buckets), BLOBS)
        .groupBy("bucket")
        .applyInArrow(_merged(window), "span_doc bigint, spans binary")
    )
    joined = rows.join(found, rows.doc_id == found.span_doc, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
