"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, written
from .words import Chunk, chunks, mix

#: Terms are hashed to this many places, one set of places for each of the counts 1, 2, and 3 or more.
PLACES = 1 << 19
_COUNTS = 3
#: A word's first bytes of these lengths are terms too, so that compounds with a common stem share one.
_STEMS = (4, 5, 6, 7, 8)

_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _trimmed(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of words without ASCII punctuation at their ends (four signs on either side at most)."""
    lo, hi = c.starts.copy(), c.ends.copy()
    for _ in range(4):
        lo += (hi > lo) & _EDGE[c.data[np.minimum(lo, len(c.data) - 1)]]
        hi -= (hi > lo) & _EDGE[c.data[np.maximum(hi - 1, 0)]]
    full = hi > lo
    return c.doc[full], lo[full], hi[full]


def terms(c: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of a chunk, each pair once: a word or stem that a row has once, twice, three times.

    wanted: index of each feature in use, -1 for the others; then only those come, as indexes.
    """
    doc, lo, hi = _trimmed(c)
    rows, places = [doc], [c.hash_of(lo, hi)]
    for n in _STEMS:
        long = hi - lo > n
        rows.append(doc[long])
        places.append(mix(c.hash_of(lo[long], lo[long] + n) + np.uint64(n)))
    row = np.concatenate(rows)
    place = (np.concatenate(places) % np.uint64(PLACES)).astype(np.int64)
    if wanted is not None:
        use = (wanted.reshape(_COUNTS, PLACES) >= 0).any(0)[place]
        row, place = row[use], place[use]
    pair, count = np.unique(row * PLACES + place, return_counts=True)
    row, place = pair // PLACES, pair % PLACES
    many = [np.flatnonzero(count > k) for k in range(_COUNTS)]
    row, feature = np.concatenate([row[m] for m in many]), np.concatenate([place[m] + k * PLACES for k, m in enumerate(many)])
    if wanted is not None:
        row, feature = row[wanted[feature] >= 0], wanted[feature[wanted[feature] >= 0]]
    return row, feature


@dataclass
class Machine:
    """score = sigmoid(bias + sum w + half of the squared sums of v less the sums of squares) over a row's features."""

    features: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def index(self) -> np.ndarray:
        out = np.full(PLACES * _COUNTS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out

    def raw(self, rows: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = self.bias + np.bincount(row, self.w[at], rows)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            total += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return total


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows of either label that have a feature."""
    total = np.zeros((2, PLACES * _COUNTS), np.int32)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(0), lower=True):
            row, feature = terms(c)
            for y in (0, 1):
                total[y] += np.bincount(feature[label[c.row + row] == y], minlength=PLACES * _COUNTS).astype(np.int32)
    some = np.flatnonzero(total.any(0))
    for lo in range(0, len(some), 100_000):
        part = some[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part].astype(np.int64)), pa.array(total[1, part].astype(np.int64))], ["feature", "n0", "n1"])


def _rows_of(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Machine(features, 0.0, features, features).index()
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                row, at = terms(c, wanted)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(c.rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.row, c.rows), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order].astype(np.int32)))], ["label", "features"])

    return run


def _descend(label: np.ndarray, row: np.ndarray, at: np.ndarray, size: int, factors: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam over mini-batches of rows, with weight decay; rows are in order of ``row``."""
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.01, (size, factors))], 1)
    bias, m, s, t = np.log((label.sum() + 1) / (len(label) - label.sum() + 1)), np.zeros_like(theta), np.zeros_like(theta), 0
    ends = np.searchsorted(row, np.arange(len(label) + 1))
    batch = max(16, min(256, len(label) // 40))
    for epoch in range(epochs):
        for docs in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            count = ends[docs + 1] - ends[docs]
            r = np.repeat(np.arange(len(docs)), count)
            a = at[np.repeat(ends[docs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(r))]
            x = theta[a]
            sums = np.stack([np.bincount(r, x[:, k], len(docs)) for k in range(x.shape[1])], 1)
            squares = np.stack([np.bincount(r, x[:, k] ** 2, len(docs)) for k in range(x.shape[1])], 1)[:, 1:]
            z = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[docs]
            grad = np.zeros_like(theta)
            grad[:, 0] = np.bincount(a, g[r], size)
            for k in range(1, x.shape[1]):
                grad[:, k] = np.bincount(a, g[r] * (sums[r, k] - x[:, k]), size)
            grad = grad / len(docs) + 1e-5 * theta
            t += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            theta -= 0.05 * 0.7**epoch * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            bias -= 0.05 * 0.7**epoch * g.mean()
    return float(bias), theta[:, 0], theta[:, 1:]


def train(texts: DataFrame, most_rows: int = 12_000, most_features: int = 4096, most_common: int = 512, factors: int = 4, epochs: int = 6, seed: int = 7) -> Machine:
    """A machine from ``doc_id, text, label`` (0 or 1), other labels left out.

    At most ``most_rows`` rows, a sample by hash of id and text, are learned
    from.  Of their features those are used whose share differs most between the
    labels (in standard errors), ``most_features`` of them, and the
    ``most_common`` most frequent others (one for 16 rows at most), so that terms
    which tell only in pairs are seen too.  Only the sample's chosen features come to the driver.
    Without rows of both labels the machine answers with the share of label 1,
    or 0.5.
    """
    known = texts.where(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    n = known.select("label").count()
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)).alias("turn")
    near = known.select("text", "label", turn).where(F.col("turn") < int(min(1.0, most_rows / max(n, 1)) * (1 << 30)))  # about most_rows; more by chance only
    known = written(near.orderBy("turn", "text", "label").limit(most_rows).select("text", "label"))
    by_label = dict(known.groupBy("label").count().collect())
    n0, n1 = by_label.get(0, 0), by_label.get(1, 0)
    none = np.zeros(0, np.int64)
    if not n0 or not n1:
        return Machine(none, float(np.log((n1 + 0.5) / (n0 + 0.5))), np.zeros(0), np.zeros((0, factors)))
    counts = known.mapInArrow(_class_counts, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    pool = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    gap = F.abs((F.col("n1") + 0.5) / (n1 + 1) - (F.col("n0") + 0.5) / (n0 + 1)) / F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1) + 1e-12)
    counts = written(counts.select("feature", gap.alias("gap"), (F.col("n0") + F.col("n1")).alias("n")))
    telling = counts.orderBy(F.desc("gap"), "feature").limit(most_features).select("feature")
    common = counts.join(F.broadcast(telling), "feature", "left_anti").orderBy(F.desc("n"), "feature").limit(min(most_common, (n0 + n1) // 16)).select("feature")
    features = np.sort(np.array([r.feature for r in telling.union(common).collect()], np.int64))
    rows = known.mapInArrow(_rows_of(features), "label int, features array<int>").toArrow()
    label = rows.column("label").to_numpy().astype(float)
    lists = rows.column("features").combine_chunks()
    at, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    return Machine(features, *_descend(label, np.repeat(np.arange(len(label)), count), at, len(features), factors, epochs, seed))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the machine's chance of label 1 for each whole text; a null or empty text gets the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most most_features rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        wanted = known.index()
        for batch in batches:
            out = []
            for c in chunks(batch.column(1), lower=True):
                row, at = terms(c, wanted)
                out.append(1 / (1 + np.exp(-np.clip(known.raw(c.rows, row, at), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **training) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``.

    Labels of documents whose crc32 of the id as text leaves 1 when divided by 3
    are held out.  Documents without a label or with a null one, and all if
    there are no labels, are scored alike; a null or empty text scores what a
    text without known terms does; a null id is scored and is not held out;
    repeated rows are each scored, and learned from once for each of their
    labels; an empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))  # clashing columns stay behind
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.select(F.col(id_col).cast("bigint").alias("_labelled"), F.col(label_col).alias("label")).where(F.col("label").isNotNull())
    learn = rows.where(~held).join(known, F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "label")
    scored = score(rows, train(learn, **training))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
