"""Ranked lexical search by scanning the documents with an automaton of all items' terms, without an index of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches

#: Characters of distinct terms, summed over items, that one automaton may hold; more items are searched for in further passes.
BLOCK_CHARS = 4_000_000
#: Candidates that a task gathers an item, in multiples of ``most``, before it keeps the best.
BUFFER = 8

#: Fixed by the definition of a term: letters and digits of ASCII, and every code point beyond.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 as the automaton reads them: letters small, all that parts terms a space.
_PLAIN = np.full(256, 32, np.uint8)
for _k in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_k] = _k
_PLAIN[65:91] = np.arange(97, 123)
_PIECE = 1 << 20


@dataclass
class Block:
    """Some items and their terms: ``of`` has the items of term t at ``ptr[t]:ptr[t + 1]``."""

    ids: pa.Array
    terms: list[str]
    ptr: np.ndarray
    of: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        """Each term between two spaces, so that it matches whole terms only; matches may share a space."""
        out = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            out.add_word(f" {term} ", k)
        if self.terms:
            out.make_automaton()
        return out


@dataclass
class Statistics:
    """Of all documents: how many have terms, all their terms, and the documents of each of a block's terms."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.df], np.int64)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _SMALL), F.lit(TERM), F.lit(0))
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()


def _blocks(terms: DataFrame) -> Iterator[Block]:
    """The items in blocks of at most BLOCK_CHARS each, or one item if it has more; only one block is on the driver at a time."""
    sizes = terms.groupBy("item_id").agg(F.sum(F.length("term") + 2).alias("chars"))
    n, worst = 1, sizes.agg(F.sum("chars")).first()[0] or 0
    while worst > BLOCK_CHARS:
        n *= 2
        held = sizes.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("block")).agg(F.sum("chars").alias("chars"), F.count("*").alias("items"))
        worst = held.where("items > 1").agg(F.max("chars")).first()[0] or 0
    for k in range(n):
        got = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow().combine_chunks()
        if len(got):
            item, term = (got.column(c).combine_chunks().dictionary_encode() for c in ("item_id", "term"))
            t, i = term.indices.to_numpy(), item.indices.to_numpy()
            order = np.lexsort((i, t))
            yield Block(item.dictionary, term.dictionary.to_pylist(), np.searchsorted(t[order], np.arange(len(term.dictionary) + 1)), i[order].astype(np.int64))


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """The number of terms of each text, null as empty, and the text as the automaton reads it."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    for lo, hi in zip(offsets, offsets[1:], strict=False):
        plain, n, inside = bytearray(b" "), 0, False
        for at in range(lo, hi, _PIECE):  # a long text's bytes are mapped in pieces
            piece = _PLAIN[data[at : min(hi, at + _PIECE)]]
            term = piece != 32
            n += int(np.count_nonzero(term[1:] & ~term[:-1])) + int(term[0] and not inside)
            inside = bool(term[-1])
            plain += piece.tobytes()
        yield n, (plain + b" ").decode() if n else ""


def _found(automaton: ahocorasick.Automaton, text: str) -> Counter:
    return Counter(map(itemgetter(1), automaton.iter(text)))


def _counting(shared):
    """Of a task's documents: (-1, those with terms), (-2, their terms), and each term of the block with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton, df, docs, total = block.automaton(), np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for n, text in _texts(batch.column(0)):
                if n:
                    docs, total = docs + 1, total + n
                    df[list(_found(automaton, text))] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [docs, total]))], ["term", "n"])

    return run


def _statistics(rows: DataFrame, shared, n_terms: int) -> Statistics:
    df, whole = np.zeros(n_terms, np.int64), {-1: 0, -2: 0}
    for r in rows.select("text").mapInArrow(_counting(shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the block at most
        if r["term"] < 0:
            whole[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return Statistics(whole[-1], whole[-2], df)


class _Best:
    """The ``most`` best documents of each item so far, and what has come since; ``floor`` is what a further one needs at least."""

    def __init__(self, items: int, most: int):
        self.most, self.floor, self.held = most, np.ones(items, np.int64), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.room = BUFFER * most * max(items, 1) + 65_536

    def add(self, scores: np.ndarray, doc: int) -> None:
        item = np.flatnonzero(scores >= self.floor)
        if len(item):
            self.parts.append((item, np.full(len(item), doc, np.int64), scores[item]))
            self.held += len(item)
            if self.held > self.room:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, doc, score = (np.concatenate(c) if self.parts else np.zeros(0, np.int64) for c in (zip(*self.parts, strict=True) if self.parts else [(), (), ()]))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.most - 1
        self.floor[item[last]] = score[last]
        keep = place < self.most
        self.parts, self.held = [(item[keep], doc[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def _ranking(shared, stats: Statistics, weights: np.ndarray, most: int):
    """Of a task's documents the ``most`` best for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton, best = block.automaton(), _Best(len(block.ids), most)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, (n, text) in zip(ids, _texts(batch.column(1)), strict=True):
                tf = _found(automaton, text) if n else None
                if tf:
                    term, times = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                    m = 50 + (50 * n * stats.n_docs) // stats.n_terms
                    gain = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m))
                    size = block.ptr[term + 1] - block.ptr[term]
                    of = np.arange(size.sum()) + np.repeat(block.ptr[term] - np.cumsum(size) + size, size)
                    scores = np.zeros(len(block.ids), np.int64)
                    np.add.at(scores, block.of[of], np.repeat(gain, size))
                    best.add(scores, doc)
        item, doc, score = best.settle()
        for at in range(0, len(item), 65_536):
            cut = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(item[cut])), pa.array(doc[cut]), pa.array(score[cut])], ["item_id", "doc_id", "score"])

    return run


def lexical_search(docs: DataFrame, items: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` documents of highest score above 0 for each item, equal scores by ascending id.

    A first scan counts the documents, their terms and the documents of each
    item's terms; a second one scores each document for all items and keeps a
    task's best.  Tasks' best meet in salted groups, of which none grows with the
    documents.  Items are held in blocks of BLOCK_CHARS; each block is two scans.

    Null and empty texts have no terms and rank nowhere, and an item without
    terms has no rows.  Rows that repeat an id of ``docs`` (integers) are documents
    each; item rows that repeat an id are one item with the terms of all.  Rows
    with a null id, of either table, are left out.  Empty tables give no rows;
    other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    schema, found = f"item_id {kind}, doc_id bigint, score bigint", []
    for block in _blocks(_item_terms(items, item_col, item_text_col)):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS bounds it
        stats = _statistics(rows, shared, len(block.terms))
        if stats.n_docs:
            found.append(rows.mapInArrow(_ranking(shared, stats, stats.weights(), most), schema))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.asc("doc_id"))
    near = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= most)
    return best.select("item_id", "rank", "doc_id", "score")
