"""Merkle manifests of a table: a tree of digests a group, and one over the groups, by sibling-shift self-joins.

Every level of all trees is one table of nodes.  It is joined with itself on
computed sibling indices (a node of slot s in its run of ``arity`` meets those of
slots s + 1, s + 2, ... modulo arity; for two that is an XOR), after which a node
holds its siblings and the node of slot zero gives the run's parent.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.order import numbered

from .tables import written

#: Rows that a range of the numbering is sized for.
RANGE_ROWS = 500_000
_RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(*texts: Column) -> Column:
    """H of texts as 32 bytes; tables hold these, hashes take them as hex text."""
    return F.unhex(F.sha2(F.concat(*texts), 256))


def _field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows give the same text; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _range_of(ids: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds an id reaches; null ids come before all."""
    if not bounds:
        return F.lit(0)

    @F.arrow_udf("int")
    def reached(values: pa.Array) -> pa.Array:
        at = np.searchsorted(np.array(bounds, np.int64), values.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(values.is_null().to_numpy(zero_copy_only=False), 0, at), pa.int32())

    return reached(ids)


def _places(leaves: DataFrame) -> DataFrame:
    """The leaves with ``idx``, from 0 in order of id within their tree, and ``n``, the tree's leaves.

    Ranges of ids split every tree, so that one with most of the rows is
    numbered in as many tasks; their bounds are fixed before rows are dealt.
    """
    rows = leaves.agg(F.count("*").alias("n")).first()["n"]
    ranges = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS))
    cuts = leaves.agg(F.percentile_approx("id", F.lit([k / ranges for k in range(1, ranges)]), F.lit(20 * ranges)).alias("cuts")).first()["cuts"] if ranges > 1 else []
    dealt = leaves.withColumn("part", _range_of(F.col("id"), sorted(set(cuts or []))))
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("tree", "part", before.alias("before"), F.sum("size").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy("id", "h")) - 1
    return dealt.withColumn("own", own).join(offsets, ["tree", "part"]).withColumn("idx", F.col("own") + F.col("before")).drop("part", "own", "before")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``lefts`` and ``rights``: the digests of the run's other nodes before and behind them, in order."""
    slot = F.col("idx") % arity
    out, lefts, rights = nodes, [], []
    for j in range(1, arity):
        other = nodes.select(F.col("tree").alias(f"tree{j}"), F.col("idx").alias(f"idx{j}"), F.col("h").alias(f"h{j}"))
        out = out.join(other, (F.col("tree") == F.col(f"tree{j}")) & (F.col("idx") - slot + (slot + j) % arity == F.col(f"idx{j}")), "left")
        there, none = F.coalesce(f"h{j}", F.lit(b"")), F.lit(b"")
        lefts.append(F.when(slot + j >= arity, there).otherwise(none))
        rights.append(F.when(slot + j < arity, there).otherwise(none))
    return out.select(*nodes.columns, F.concat(*lefts).alias("lefts"), F.concat(*rights).alias("rights"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The nodes one level up, each from its run's node of slot zero."""
    up = (F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"))
    return level.where((F.col("idx") % arity == 0) & (F.col("n") > 1)).select("tree", *up, _digest(_text(F.col("h")), _text(F.col("rights"))).alias("h"))


def _levels(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all trees (``tree, idx, n, h, lefts, rights``) and ``tree, top, height``.

    A level has the nodes of trees that have several there; level 0 has all leaves.
    """
    most = leaves.agg(F.max("n")).first()[0]
    levels = [written(_with_siblings(leaves, arity))]
    tops = [levels[0].where("n = 1").select("tree", F.col("h").alias("top"), F.lit(0).alias("height"))]
    while most > 1:
        up, most = _parents(levels[-1], arity), -(-most // arity)
        tops.append(up.where("n = 1").select("tree", F.col("h").alias("top"), F.lit(len(levels)).alias("height")))
        if most > 1:
            levels.append(written(_with_siblings(up.where("n > 1"), arity)))
    return levels, written(reduce(DataFrame.unionByName, tops))


def _with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves of level 0 with ``path``, the siblings' digests of each level up to the top and on by the top's own ``path``, and ``top``.

    Paths go down a level at a time by the parent's index, so no tree's rows meet at its top.
    """
    step = F.array(F.struct("lefts", "rights"))
    above = lambda k: tops.where(F.col("height") == k).select(F.col("tree").alias("up_tree"), F.lit(0).cast("bigint").alias("up_idx"), "top", "path")
    known = above(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        of = (F.col("tree") == F.col("up_tree")) & (F.expr(f"idx div {arity}") == F.col("up_idx"))
        here = levels[k].where("n > 1").join(known, of).withColumn("path", F.concat(step, "path")).drop("up_tree", "up_idx")
        if k:
            known = here.select(F.col("tree").alias("up_tree"), F.col("idx").alias("up_idx"), "top", "path").unionByName(above(k))
    return here.unionByName(levels[0].where("n = 1").join(above(0), F.col("tree") == F.col("up_tree")).drop("up_tree", "up_idx"))


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), now: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", arity: int = 3
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    A row's leaf is the digest of its ``columns``; leaves of a ``group_col`` make
    a tree in order of ``id_col`` (integers), the groups' tops make one in order
    of the group (null first, then by bytes of UTF-8).  ``now`` gives columns as
    they are found later, by name; each row's leaf of these is folded with the
    row's recorded siblings, and ``verified`` says whether that gives the root.

    Null values of any column have their own mark; a row with a null id is a leaf
    before all others.  Rows that repeat an id are leaves each, in order of their
    digests; a table with one row has its leaf as its root; an empty table gives
    no rows.  Texts are read once and never shuffled; other columns aren't read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null before all, which is "="
    later = [_field((now or {}).get(c, F.col(c))) for c in columns]
    leaves = written(docs.select(tree.alias("tree"), F.col(id_col).cast("bigint").alias("id"), _digest(*[_field(F.col(c)) for c in columns]).alias("h"), _digest(*later).alias("later")))
    if leaves.isEmpty():
        return leaves.sparkSession.createDataFrame([], _RESULT)
    levels, groups = _levels(written(_places(leaves)), arity)
    rows = groups.count()
    heads = written(numbered(groups.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "height", F.lit(rows).cast("bigint").alias("n"), F.col("top").alias("h")), "group", into="idx"))
    upper, root = _levels(heads, arity)
    none = F.array().cast("array<struct<lefts:binary,rights:binary>>")
    of_groups = _with_paths(upper, root.withColumn("path", none), arity)
    found = _with_paths(levels, written(of_groups.select(F.col("group").alias("tree"), "height", F.struct(F.col("h").alias("sub"), F.col("top").alias("all")).alias("top"), "path")), arity)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: _text(F.concat(x["lefts"], x["rights"]))), ""), 256)
    folded = F.aggregate("path", _text(F.col("later")), lambda acc, x: F.sha2(F.concat(_text(x["lefts"]), acc, _text(x["rights"])), 256))
    out = found.select(F.col("id").alias("doc_id"), _text(F.col("h")).alias("leaf"), _text(F.col("top.sub")).alias("subroot"), _text(F.col("top.all")).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
