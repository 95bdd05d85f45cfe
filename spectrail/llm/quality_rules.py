"""Quality rules whose thresholds adapt to each language and source through mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, written
from .words import Chunk, chunks, mix, per_row

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: For each measure: the least spread that counts, and the sides on which a document can lie too far out.
MEASURES = {
    "symbols_per_word": (0.02, "high"),
    "mean_word_length": (0.25, "both"),
    "upper_share": (0.03, "high"),
    "dup_line_share": (0.1, "high"),
    "repeat_share": (0.03, "high"),
}


def _repeat_words(c: Chunk, n: int = 5) -> np.ndarray:
    """Words inside n-word windows that a row has twice or more."""
    at, h = c.windows(n)
    key = mix(h + c.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    many = np.zeros(len(at), bool)
    many[1:] |= same
    many[:-1] |= same
    step = np.zeros(len(c.hash) + 1, np.int64)
    np.add.at(step, at[order[many]], 1)
    np.add.at(step, at[order[many]] + n, -1)
    return per_row(np.cumsum(step[:-1]) > 0, c.first)


def _dup_lines(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their row; all lines with a word."""
    cuts = np.flatnonzero(c.data == 10)
    lo = np.sort(np.concatenate([c.offsets[:-1], cuts + 1]), kind="stable")
    hi = np.sort(np.concatenate([c.offsets[1:], cuts]), kind="stable")
    full = np.searchsorted(c.starts, hi) > np.searchsorted(c.starts, lo)
    lo, hi = lo[full], hi[full]
    row = np.searchsorted(c.offsets, lo, "right") - 1
    key = mix(c.hash_of(lo, hi) + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(key), bool)
    dup[order[1:]] = key[order][1:] == key[order][:-1]
    return np.bincount(row[dup], minlength=c.rows), np.bincount(row, minlength=c.rows)


def counts_of(c: Chunk) -> np.ndarray:
    """The counts (a row for each of _COUNTS) of a chunk's rows."""
    upper = (c.data >= 65) & (c.data <= 90)
    letter = upper | (c.data >= 97) & (c.data <= 122)
    two = np.zeros(len(c.data), bool)  # the second byte of an accented Latin letter
    two[1:] = (c.data[:-1] == 0xC3) & (c.data[1:] >= 0x80)
    upper |= two & (c.data <= 0x9E)
    point = ((c.data & 0xC0) != 0x80) & ~c.space  # every sign that parts words is one byte
    dup, lines = _dup_lines(c)
    each = [np.diff(c.first), per_row(point, c.offsets), per_row(_SYMBOL[c.data], c.offsets), dup, _repeat_words(c), lines, per_row(upper, c.offsets), per_row(letter | two, c.offsets)]
    return np.stack([x.astype(np.int64) for x in each])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each row after its columns but the last, which is the text."""
    for batch in batches:
        keep = batch.num_columns - 1
        parts = [counts_of(c) for c in chunks(batch.column(keep))]
        if parts:
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *map(pa.array, np.concatenate(parts, 1))], [*batch.schema.names[:keep], *_COUNTS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and measures of each document; null lang and source as empty strings."""
    small_batches(docs.sparkSession)
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), group("lang"), group("source"), F.col(text_col).alias("text"))
    return with_measures(rows.mapInArrow(_counts, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS)))


def with_measures(counts: DataFrame) -> DataFrame:
    """The rows with what their counts give as shares."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.withColumns(
        {
            "symbols_per_word": share("n_symbols", "n_words"),
            "mean_word_length": share("word_chars", "n_words"),
            "upper_share": share("n_upper", "n_letters"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
        }
    )


def thresholds(measures: DataFrame, reach: float = 6.0, least_rows: int = 100, k: int = 2048) -> DataFrame:
    """Limits of each (lang, source) from KLL sketches of the measures.

    The spread below the median, which rubbish on the high side doesn't move,
    is median - 10 % quantile, or the measure's least spread if that is larger;
    limits lie ``reach`` spreads from the median.  Sketches of sources merge to
    their language's and to one of all; a group of fewer than ``least_rows``
    rows takes the language's limits, a language of fewer all documents'.
    """
    sketch = [F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]
    merge = [F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]
    by_source = measures.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketch)
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("lang_n"), *[x.alias(f"lang_{m}") for m, x in zip(MEASURES, merge, strict=True)])
    overall = by_source.agg(*[x.alias(f"all_{m}") for m, x in zip(MEASURES, merge, strict=True)])
    out = by_source.join(by_lang, "lang").crossJoin(F.broadcast(overall))  # one row of at most len(MEASURES) sketches of fixed size
    limits = {}
    for m, (least, sides) in MEASURES.items():
        use = F.when(F.col("n") >= least_rows, F.col(m)).when(F.col("lang_n") >= least_rows, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        mid, low = (F.kll_sketch_get_quantile_double(use, F.lit(r)) for r in (0.5, 0.1))
        spread = F.greatest(mid - low, F.lit(least))
        limits[f"{m}_high"] = mid + reach * spread
        limits[f"{m}_low"] = mid - reach * spread if sides == "both" else F.lit(float("-inf"))
    return out.select("lang", "source", *[x.alias(n) for n, x in limits.items()])


def quality_rules(docs: DataFrame, reach: float = 6.0, least_rows: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``base_failed``: fewer than 10 words, or over 20 % of them in repeated
    5-word windows.  Other documents are kept if every measure lies within the
    limits of their language and source.  A null or empty text has no words and
    fails; a null lang or source is a group of its own; repeated rows are each
    judged and each counted; an empty table gives no rows.
    """
    rows = written(measured(docs, id_col, text_col))
    limits = thresholds(rows, reach, least_rows)
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.join(limits, ["lang", "source"]).select("doc_id", *_COUNTS[:5], failed.alias("base_failed"), (~failed & inside).alias("kept"))
