"""Quality from weak labels: expectation-maximisation over overlapping labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import counts_of
from .tables import small_batches
from .words import Chunk, chunks, mix, per_row

#: Each labeller votes good (1) in the first range of its measure, poor (-1) outside the second, and abstains between.
#: They overlap: rubbish that one of them sees is seen by others too, from which their accuracies can be told.
LABELLERS = {
    "symbols_per_word": ((0.0, 0.1), (0.0, 0.4)),
    "mean_word_length": ((3.5, 9.0), (2.5, 14.0)),
    "upper_share": ((0.0, 0.12), (0.0, 0.4)),
    "repeat_share": ((0.0, 0.12), (0.0, 0.35)),
    "dup_line_share": ((0.0, 0.2), (0.0, 0.6)),
    "n_words": ((15.0, np.inf), (0.0, np.inf)),
    "plain_share": ((0.85, 1.0), (0.6, 1.0)),
    "sign_run_share": ((0.0, 0.05), (0.0, 0.25)),
    "letterless_share": ((0.0, 0.1), (0.0, 0.25)),
    "again_share": ((0.0, 0.05), (0.0, 0.2)),
    "top_word_share": ((0.0, 0.2), (0.0, 0.35)),
}

WORD_LABELLERS = {"plain_share", "sign_run_share", "letterless_share", "again_share", "top_word_share"}

PLACES = 1 << 16


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[k for k in range(33, 127) if not chr(k).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def measures(c: Chunk) -> dict[str, np.ndarray]:
    """The labellers' measures of a chunk's rows; shares of nothing are 0, plain_share then is 1."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters = counts_of(c).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    in_words = lambda mark: share(per_row(mark, c.first).astype(float), n_words)
    size = c.ends - c.starts
    odd = np.add.reduceat(~_LETTER[c.data] & ~c.space, c.starts, dtype=np.int64) if len(c.starts) else size
    last = c.data[c.ends - 1] if len(c.starts) else c.data[:0]
    again = np.zeros(len(c.hash), bool)
    again[1:] = (c.hash[1:] == c.hash[:-1]) & (c.doc[1:] == c.doc[:-1])
    order = np.lexsort((c.hash, c.doc))
    edge = np.flatnonzero(np.append(True, (np.diff(c.hash[order]) != 0) | (np.diff(c.doc[order]) != 0))[: len(order)])
    top = np.zeros(c.rows)
    np.maximum.at(top, c.doc[order[edge]], np.diff(edge, append=len(order)))
    return {
        "symbols_per_word": share(n_symbols, n_words),
        "mean_word_length": share(word_chars, n_words),
        "upper_share": share(n_upper, n_letters),
        "repeat_share": share(n_repeat_words, n_words),
        "dup_line_share": share(n_dup_lines, n_lines),
        "n_words": n_words,
        "plain_share": np.where(n_words > 0, in_words((odd == 0) | (odd == 1) & _STOP[last]), 1.0),
        "sign_run_share": in_words((size > 1) & _SIGN[last] & _SIGN[c.data[np.maximum(c.ends - 2, 0)]]) if len(c.starts) else np.zeros(c.rows),
        "letterless_share": in_words(odd == size),
        "again_share": in_words(again),
        "top_word_share": share(top, n_words),
    }


def votes(c: Chunk) -> np.ndarray:
    """A row for each of the chunk's rows with each labeller's vote; those of WORD_LABELLERS abstain on a text of fewer than 20 words, of which few words tell nothing."""
    out, found = [], measures(c)
    for name, x in found.items():
        (lo, hi), (least, most) = LABELLERS[name]
        vote = np.where((x >= lo) & (x <= hi), 1, np.where((x >= least) & (x <= most), 0, -1))
        out.append(np.where(found["n_words"] < 20, 0, vote) if name in WORD_LABELLERS else vote)
    return np.stack(out, 1)


def labeller_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Prior of good, and each labeller's chance to vote poor, given that it votes, on poor and on good documents.

    patterns has a row for each combination of votes that occurs, counts its
    documents; abstaining says nothing.  Expectation-maximisation estimates all
    of these; it starts from documents of whose labellers one at least votes for
    poor against the others, which settles what the two classes mean.
    """
    good = np.where((patterns == -1).any(1), 0.1, 0.9)
    prior, chances = 0.5, np.full((patterns.shape[1], 2), 0.5)
    for _ in range(rounds):
        mass = np.stack([(1 - good) * counts, good * counts])
        prior = float(np.clip((mass[1].sum() + 1) / (mass.sum() + 2), 0.001, 0.999))
        chances = np.stack([(mass[:, patterns[:, j] == -1].sum(1) + [1.0, 0.1]) / (mass[:, patterns[:, j] != 0].sum(1) + 2) for j in range(patterns.shape[1])])
        new = posterior(patterns, prior, chances)
        if np.abs(new - good).max(initial=0) < 1e-7:
            break
        good = new
    return prior, chances


def posterior(patterns: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """Chance of good of each combination of votes."""
    odds = np.full(len(patterns), np.log(prior / (1 - prior)))
    for j, (on_poor, on_good) in enumerate(chances):
        odds += np.select([patterns[:, j] == -1, patterns[:, j] == 1], [np.log(on_good / on_poor), np.log((1 - on_good) / (1 - on_poor))], 0.0)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed places and shares of words by their last two bytes, the kinds of their first four, and being like the word before."""
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 3, 1
    count = np.maximum(np.diff(c.first), 1)
    size = c.ends - c.starts
    tail = c.hash_of(np.maximum(c.ends - 2, c.starts), c.ends)
    shape = np.minimum(size, 4).astype(np.uint64)
    for k in range(4):
        byte = c.data[np.minimum(c.starts + k, len(c.data) - 1)] if len(c.data) else np.zeros(0, np.uint8)
        kind = np.where(kinds[byte] > 0, kinds[byte], byte)
        shape = shape * np.uint64(257) + np.where(size > k, kind, 0).astype(np.uint64)
    again = np.zeros(len(c.hash), bool)
    again[1:] = (c.hash[1:] == c.hash[:-1]) & (c.doc[1:] == c.doc[:-1])
    row = np.concatenate([c.doc, c.doc, c.doc[again]])
    place = np.concatenate([tail, mix(shape + np.uint64(1 << 40)), np.full(int(again.sum()), np.uint64(77))]) % np.uint64(PLACES)
    pair, n = np.unique(row * PLACES + place.astype(np.int64), return_counts=True)
    row = pair // PLACES
    return row, pair % PLACES, np.sqrt(n / count[row])


def _vote_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combinations of votes of a task's documents, as bytes, with their number."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        for c in chunks(batch.column(0)):
            each, n = np.unique(votes(c).astype(np.int8), axis=0, return_counts=True)
            for v, k in zip(each, n.tolist(), strict=True):
                seen[v.tobytes()] = seen.get(v.tobytes(), 0) + k
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])


def _marked(prior: float, chances: np.ndarray):
    """Chance of good by the labellers, and hashed features, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                row, place, share = _features(c)
                ends = pa.array(np.searchsorted(row, np.arange(c.rows + 1)), pa.int32())
                good = posterior(votes(c), prior, chances)
                yield pa.RecordBatch.from_arrays([pa.array(good), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(share, pa.float32()))], ["good", "places", "shares"])

    return run


@dataclass
class Scorer:
    bias: float
    weights: np.ndarray


def _fit(good: np.ndarray, row: np.ndarray, place: np.ndarray, share: np.ndarray, steps: int = 150) -> Scorer:
    """Logistic regression on soft labels by full-batch Adam."""
    used, at = np.unique(place, return_inverse=True)
    w, m, s, bias = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.0
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[at] * share, len(good))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / len(good)
        grad = np.append(np.bincount(at, g[row] * share, len(used)), g.sum()) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    bias, weights = float(w[-1]), np.zeros(PLACES)
    weights[used] = w[:-1]
    return Scorer(bias, weights)


def training_sample(rows: DataFrame, n: int, most_rows: int, seed: int) -> DataFrame:
    """At most ``most_rows`` texts of ``n`` rows of ``doc_id, text``, by hash of both, so that a frequent text has its share."""
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)).alias("turn")
    near = rows.select("text", turn).where(F.col("turn") < int(min(1.0, most_rows / n) * (1 << 30)))  # about most_rows; more by chance only, or by rows that repeat both
    return near.orderBy("turn", "text").limit(most_rows).select("text")


def train(docs: DataFrame, most_rows: int = 8_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """The labellers' accuracies from all documents, then a scorer from a sample of at most ``most_rows``.

    EM needs the number of documents of each combination of votes only, at
    most 3 ** len(LABELLERS) rows and in fact those that occur.  The sample, by
    hash of id and text, comes to the driver as hashed features.  An empty table
    gives a scorer that answers 0.5.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = rows.select("text").mapInArrow(_vote_counts, "votes binary, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    n = sum(r.n for r in seen)
    if not n:
        return Scorer(0.0, np.zeros(PLACES))
    patterns = np.stack([np.frombuffer(r.votes, np.int8) for r in seen]).astype(np.int64)
    model = labeller_model(patterns, np.array([r.n for r in seen], float))
    got = training_sample(rows, n, most_rows, seed).mapInArrow(_marked(*model), "good double, places array<int>, shares array<float>").toArrow().combine_chunks()
    places, shares = got.column("places").combine_chunks(), got.column("shares").combine_chunks()
    row = np.repeat(np.arange(len(got)), np.diff(places.offsets.to_numpy()))
    return _fit(got.column("good").to_numpy(), row, places.flatten().to_numpy(), shares.flatten().to_numpy().astype(float))


def quality_classifier(docs: DataFrame, scorer: Scorer | None = None, cutoff: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The documents with ``quality_score`` (0 to 1) and ``kept`` (they replace columns of these names).

    ``kept`` is a score of ``cutoff`` or more (a score that equals it is kept); a
    null text or one without words scores 0.  Repeated rows are each scored and
    each counted; a row with a null id is scored like any other.  Training is on
    these documents unless a scorer is given; an empty table gives no rows, with
    or without one.  Other columns pass through unread.
    """
    small_batches(docs.sparkSession)
    scorer = train(docs, id_col=id_col, text_col=text_col, **training) if scorer is None else scorer
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # PLACES weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = shared.value
        out = []
        for c in chunks(texts):
            row, place, share = _features(c)
            z = known.bias + np.bincount(row, known.weights[place] * share, c.rows)
            out.append(np.where(np.diff(c.first) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("quality_score", score(F.col(text_col))).withColumn("kept", F.col("quality_score") >= cutoff)
