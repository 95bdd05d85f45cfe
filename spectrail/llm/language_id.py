"""Languages by a string kernel: blended-spectrum presence kernels with landmarks, and ridge regression one language against the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import small_batches, written

#: Lengths in bytes of the n-grams, and hashed places of them; n-grams that share a place count as one.
LENGTHS = (1, 2, 3, 4)
PLACES_BITS = 17
PLACES = 1 << PLACES_BITS
#: Rows of a kernel block, and bytes of a text taken at once.
ROWS, PIECE = 128, 1 << 18
#: What is returned for texts without a letter.
NONE = "und"

#: Everything in ASCII that isn't a small letter reads as a space; texts are lower-cased before.
_PLAIN = np.arange(256, dtype=np.uint64)
_PLAIN[[k for k in range(128) if not 97 <= k <= 122]] = 32


@dataclass
class LanguageModel:
    """Landmarks as rows of presence over ``places`` and the regression's weight of each landmark's kernel for each language."""

    languages: list[str]
    places: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self) -> np.ndarray:
        """Presence over ``places`` times this gives dot products with landmarks, these of length 1."""
        return (self.landmarks / np.sqrt(np.maximum(self.landmarks.sum(1, keepdims=True), 1))).T.astype(np.float32)


def _mark(data: np.ndarray, row: np.ndarray) -> None:
    """Mark the places of the n-grams of a text's bytes; a long text is taken in pieces that overlap by the longest n-gram."""
    for at in range(0, len(data), PIECE):
        byte = _PLAIN[data[at : at + PIECE + max(LENGTHS) - 1]]
        gram = np.zeros(len(byte), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            gram = gram[: len(byte) - n + 1] * np.uint64(256) + byte[n - 1 :]
            if not len(gram):
                break
            if n in LENGTHS:
                row[((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES_BITS)] = 1


def presence(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of at most ROWS rows by PLACES, 1 where a lower-cased text has an n-gram; null texts have none."""
    for first in range(0, len(column), ROWS):
        part = pc.utf8_lower(column.slice(first, ROWS).cast(pa.large_string()).fill_null(""))
        _, ends, body = part.buffers()
        offsets = np.frombuffer(ends, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        block = np.zeros((len(part), PLACES), np.uint8)
        for row, lo, hi in zip(block, offsets, offsets[1:], strict=False):
            _mark(data[lo:hi], row)
        yield block


def _kernels(block: np.ndarray, places: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Normalised kernels of a block's rows with all landmarks: one matrix product."""
    own = np.sqrt(np.maximum(np.count_nonzero(block, axis=1), 1))
    return (block[:, places].astype(np.float32) @ kernel) / own[:, None].astype(np.float32)


def _letters(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's language, place and presence as bits."""
    for batch in batches:
        bits = [np.packbits(row).tobytes() for block in presence(batch.column(2)) for row in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["lang", "place", "bits"])


def _kernel_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kernel = model.kernel()
        for batch in batches:
            for k, block in enumerate(presence(batch.column(2))):
                rows = pa.array(list(_kernels(block, model.places, kernel)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k * ROWS, len(block)) for c in (0, 1)), rows], ["lang", "place", "k"])

    return run


def _ridge(among: np.ndarray, rows: np.ndarray, lang: np.ndarray, languages: int, ridge: float) -> np.ndarray:
    """Weights of landmarks: ridge regression of +1 / -1 for each language, every language with the same mass, in the landmarks' feature space."""
    values, vectors = np.linalg.eigh(among)
    used = values > 1e-6 * values[-1]
    to_features = vectors[:, used] / np.sqrt(values[used])
    x = rows @ to_features
    mass = 1 / np.bincount(lang, minlength=languages)[lang] / languages
    y = np.where(lang[:, None] == np.arange(languages), 1.0, -1.0)
    return to_features @ np.linalg.solve((x.T * mass) @ x + ridge * np.eye(x.shape[1]), (x.T * mass) @ y)


def train(labelled: DataFrame, most_landmarks: int = 192, most_rows: int = 6_000, most_languages: int = 96, ridge: float = 1e-4, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from rows with a text that has a letter and a language; None if there are none.

    The fit takes at most ``most_rows`` texts, of them at most
    ``most_landmarks`` as landmarks, shared evenly between the
    ``most_languages`` most frequent languages (by name if equal): by hash of id
    and text, so that copies have no larger chance than other rows.  What comes
    to the driver is the landmarks' presence bits and a row of kernels a text.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    each, turns = max(1, most_rows // len(sizes)), 1 << 30
    limits = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2 * each / r["count"]) * turns)) for r in sizes], "lang string, below bigint")
    turn = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(turns)).alias("turn")
    near = rows.select("lang", "text", turn).join(F.broadcast(limits), "lang").where("turn < below")  # most_languages rows
    place = F.row_number().over(W.partitionBy("lang").orderBy("turn", "text")).alias("place")
    sample = written(near.select("lang", "text", place).where(F.col("place") <= each))
    order = [("lang", "ascending"), ("place", "ascending")]  # the fit doesn't depend on how rows are dealt, but for rounding
    packed = sample.where(F.col("place") <= max(1, most_landmarks // len(sizes))).select("lang", "place", "text").mapInArrow(_packed, "lang string, place int, bits binary").toArrow().sort_by(order)
    bits = np.stack([np.unpackbits(np.frombuffer(b.as_py(), np.uint8)) for b in packed.column("bits")])
    places = np.flatnonzero(bits.any(0))
    model = LanguageModel(languages, places, bits[:, places], np.zeros((len(bits), len(languages))))
    shared = labelled.sparkSession.sparkContext.broadcast(model)  # most_landmarks x PLACES bytes at most
    got = sample.select("lang", "place", "text").mapInArrow(_kernel_rows(shared), "lang string, place int, k array<float>").toArrow().sort_by(order)
    kernels = np.stack([np.asarray(k.values, np.float64) for k in got.column("k")])
    dot = model.landmarks.astype(np.float64) @ model.kernel()
    among = dot / np.sqrt(np.maximum(model.landmarks.sum(1, keepdims=True), 1))
    model.weights = _ridge((among + among.T) / 2, kernels, np.searchsorted(languages, np.array(got.column("lang").to_pylist())), len(languages), ridge)
    return model


def predicted(text: Column, model: LanguageModel | None, spark) -> Column:
    """A struct ``lang_pred, score`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        known, letters = shared.value, _letters(texts)
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if known is not None:
            kernel, at = known.kernel(), 0
            for block in presence(texts):
                values = _kernels(block, known.places, kernel) @ known.weights
                best[at : at + len(block)], score[at : at + len(block)] = values.argmax(1), np.clip((1 + values.max(1)) / 2, 0, 1)
                at += len(block)
        told = letters & (known is not None)
        names = np.array([*(known.languages if known is not None else ()), NONE], object)
        return pa.StructArray.from_arrays([pa.array(names[np.where(told, best, len(names) - 1)], pa.string()), pa.array(np.where(told, score, 0.0))], ["lang_pred", "score"])

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: a fourth, by checksum of the id; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """The documents with ``held_out``, ``lang_pred`` and ``score`` (they replace columns of these names).

    ``lang_pred`` is a learned language, the first by name of equals; ``und``,
    with a score of 0, for a null text, one without a letter, and every text if
    there was nothing to learn.  ``score`` is half of 1 and the regression's
    value for that language, cut to 0 and 1.  Without a model it is trained on
    the rows that aren't held out and have an id and a language.  Whole texts
    are read, long ones in pieces; rows that repeat are scored each; an empty
    table gives no rows; other columns pass through unread.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if model is None:
        model = train(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **training)
    out = docs.withColumns({"held_out": held_out(id_col), "_predicted": predicted(F.col(text_col), model, spark)})
    return out.withColumns({"lang_pred": F.col("_predicted.lang_pred"), "score": F.col("_predicted.score")}).drop("_predicted")
