"""Benchmark decontamination by MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Sketch rows of all items, and candidate pairs, up to which they are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _each_shingle(text: Column, n: int, of: Callable[[Column, Column], Column]) -> Column:
    """of(words, k) for the start k of each n-word shingle of a lower-cased text, repeats included; a text of fewer words has one start, one of none has none."""
    words = _words(text)
    # The array around the words binds them to w, so that a text is split once and not once a shingle.
    runs = F.transform(F.array(words), lambda w: F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), F.lit(1), F.size(w)), lambda k: of(w, k)))
    return F.get(runs, F.lit(0))


def _shingle(words: Column, k: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words, k + 1, n))


def _hash(words: Column, k: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, k + i) for i in range(n)])


def _shingle_hashes(text: Column, n: int) -> Column:
    return _each_shingle(text, n, lambda w, k: _hash(w, k, n))


def item_sketches(items: DataFrame, n: int = 5, percent: int = 80, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's distinct shingles, how many a document must hold, and its MinHash sketch.

    Of an item with m shingles, ceil(percent * m / 100) must be found, so m minus
    that may miss; the sketch has one shingle more, those of least hash.  Whatever
    contains the item therefore has a shingle of the sketch: the search loses none.
    The sketch's length grows with the item's size.
    """
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.arrays_zip(_shingle_hashes(F.col(text_col), n).alias("h"), _each_shingle(F.col(text_col), n, lambda w, k: _shingle(w, k, n)).alias("s")).alias("both"))
    rows = rows.select("item_id", F.array_sort(F.array_distinct("both")).alias("both")).where(F.size("both") > 0)
    rows = rows.select("item_id", F.col("both.s").alias("item_shingles"), F.col("both.h").alias("hashes"), F.size("both").alias("n_item"))
    rows = rows.withColumn("n_needed", F.ceil(F.col("n_item") * percent / F.lit(100)).cast("int"))
    return rows.withColumn("sketch", F.slice("hashes", F.lit(1), F.col("n_item") - F.col("n_needed") + 1))


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Items that documents contain: ``doc_id, item_id, n_item, n_shared, containment``, one row for each such pair.

    A document contains an item if it has ``percent`` % or more of the item's
    distinct n-word shingles.  Items are parted by size (a power of two): a part
    is searched only in documents that have as many shingles as its smallest
    need.  Candidates share a hash of the item's sketch; all are verified
    with exact shingles.  Null or empty texts contain nothing and aren't
    contained; rows with a null id take no part; of rows that
    repeat an id the one that shares most counts; an empty table on either side
    gives no rows; other columns, whatever their names, aren't read.  An item of
    m words, fewer than n, is one shingle of m words, and is searched in the
    documents' shingles of m words.
    """
    words = F.size(_words(F.col(item_text_col)))
    short = [r["m"] for r in items.where(F.col(item_col).isNotNull()).select(F.least(words, F.lit(n)).alias("m")).where(F.col("m").between(1, n - 1)).distinct().orderBy("m").collect()]  # n - 1 rows at most
    parts = [_contained(docs, items.where(words == m), m, percent, id_col, text_col, item_col, item_text_col) for m in short]
    return reduce(DataFrame.unionByName, parts, _contained(docs, items.where(words >= n) if short else items, n, percent, id_col, text_col, item_col, item_text_col))


def _contained(docs: DataFrame, items: DataFrame, n: int, percent: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The same for items of n words or more."""
    sketches = written(item_sketches(items, n, percent, item_col, item_text_col))
    part = F.floor(F.log2("n_needed"))
    probes = sketches.select("item_id", part.alias("part"), F.explode("sketch").alias("hash"))
    probes = F.broadcast(probes) if probes.count() <= BROADCAST_ROWS else probes
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    hashed = rows.select("doc_id", _shingle_hashes(F.col("doc_text"), n).alias("doc_hashes"))
    found = hashed.select("doc_id", F.floor(F.log2(F.size("doc_hashes"))).alias("room"), F.explode("doc_hashes").alias("hash"))
    candidates = written(found.join(probes, "hash").where(F.col("part") <= F.col("room")).select("doc_id", "item_id").distinct())
    few = candidates.count() <= BROADCAST_ROWS  # 16 bytes each; then the texts aren't shuffled
    checked = rows.join(F.broadcast(candidates) if few else candidates, "doc_id").join(sketches.drop("sketch"), "item_id")
    same = _each_shingle(F.col("doc_text"), n, lambda w, k: F.when(F.array_contains("hashes", _hash(w, k, n)), _shingle(w, k, n)))
    checked = checked.select("doc_id", "item_id", "n_item", "n_needed", F.size(F.array_intersect(same, F.col("item_shingles"))).alias("n_shared"))
    checked = checked.groupBy("doc_id", "item_id", "n_item", "n_needed").agg(F.max("n_shared").alias("n_shared")).where(F.col("n_shared") >= F.col("n_needed"))
    return checked.select("doc_id", "item_id", F.col("n_item").cast("bigint").alias("n_item"), F.col("n_shared").cast("bigint").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))
