"""Line deduplication by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Rows of the leaf table up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, least_tokens: int) -> DataFrame:
    """Each line of at least least_tokens with its leaf: the number of its tokens and the first ones, those with a digit masked."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    rows = rows.select("doc", "line_no", F.array_remove(F.split("line", " "), "").alias("tokens")).where(F.size("tokens") >= least_tokens)
    lead = [_masked(F.get("tokens", F.lit(k))) for k in range(depth)]  # null beyond a short line's end
    return rows.withColumn("leaf", F.xxhash64(F.size("tokens"), *lead))


def _documents(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct documents of each key, counted with two levels so that no task sees all rows of a frequent one."""
    return rows.select(*keys, "doc").distinct().groupBy(*keys).agg(F.count("*").alias("n_docs"))


def _fewest_fixed(n: Column, agree_percent: int) -> Column:
    """Fixed positions that a template of ``n`` tokens must keep: ``agree_percent`` % of those that ``agree_percent`` % of all leave, as after one widening."""
    part = lambda x: F.floor((x * agree_percent + 99) / 100)
    return part(part(n))


def _recurring(found: DataFrame, groups: DataFrame, least_docs: int) -> DataFrame:
    """The ``leaf, template`` of ``groups`` (``leaf, masked, template``) that ``least_docs`` documents have."""
    return _documents(found.join(groups, ["leaf", "masked"]), "leaf", "template").where(F.col("n_docs") >= least_docs).select("leaf", "template")


def _telling(own: DataFrame) -> DataFrame:
    """``node, place`` of each node whose lines differ: where they have the fewest different tokens, two at least; of equals where most lines have a fixed one, then the first."""
    at = own.select("node", "n_docs", F.posexplode("t").alias("place", "token")).groupBy("node", "place", "token").agg(F.sum("n_docs").alias("n"))
    kinds = at.groupBy("node", "place").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("token") != "\n", F.col("n")).otherwise(0)).alias("held")).where("kinds > 1")
    return kinds.groupBy("node").agg(F.min_by("place", F.struct("kinds", -F.col("held"), "place")).alias("place"))


def _further_templates(found: DataFrame, groups: DataFrame, least_docs: int, agree_percent: int) -> DataFrame | None:
    """``leaf, masked, template`` of the lines of ``groups`` (``leaf, masked, n_docs``) that have a recurring template.

    A level of the tree a round, all nodes at once; a node is a leaf at first.
    Tokens that fewer than ``least_docs`` documents have at their place in a
    node are variable, as no recurring template can fix them; lines with too few
    fixed tokens are done.  Equal lines of what is left are a template if enough
    documents have it; else the node's most frequent line and those that agree
    with it are taken, if they are enough.  What remains is split by the token at
    the place that tells most (see _telling), which is the same in a node from
    then on.  So there are no more rounds than a line has tokens, and a node of
    too few documents ends whatever its lines look like.
    """
    out, left, k = [], groups.withColumn("node", F.col("leaf")), 0
    while True:
        at = left.select("leaf", "node", "masked", "n_docs", F.posexplode(F.split("masked", " ")).alias("place", "token"))
        fixed = at.groupBy("node", "place", "token").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= least_docs).select("node", "place", "token", F.lit(True).alias("fixed"))
        tokens = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise("\n").alias("token"))))
        own = at.join(fixed, ["node", "place", "token"], "left").groupBy("leaf", "node", "masked", "n_docs").agg(tokens.alias("t")).select("leaf", "node", "masked", "n_docs", F.col("t.token").alias("t"))
        kept = F.size(F.filter("t", lambda x: x != "\n"))
        own = written(own.where(kept >= _fewest_fixed(F.size("t"), agree_percent)).withColumn("template", F.xxhash64(F.lit(f"same {k}"), "node", F.array_join("t", " "))))
        if own.isEmpty():
            break
        same = written(own.join(_recurring(found, own.select("leaf", "masked", "template"), least_docs), ["leaf", "template"], "left_semi").select("leaf", "node", "masked", "template"))
        rest = own.join(same.select("node").distinct(), "node", "left_anti")
        seeds = rest.groupBy("node", "t", "template").agg(F.sum("n_docs").alias("n")).groupBy("node").agg(F.max_by(F.struct(F.col("t").alias("seed_t"), F.col("template").alias("seed")), F.struct("n", F.array_join("t", " "))).alias("seed")).select("node", "seed.*")
        agree = F.size(F.filter(F.zip_with("t", "seed_t", lambda a, b: (a == b) & (a != "\n")), lambda same: same))
        star = rest.join(seeds, "node").where(agree >= _fewest_fixed(F.size("t"), agree_percent)).select("leaf", "masked", F.xxhash64(F.lit(f"star {k}"), "seed").alias("template"))
        near = written(star.join(_recurring(found, star, least_docs), ["leaf", "template"], "left_semi").select("leaf", "masked", "template"))
        out += [same.select("leaf", "masked", "template"), near]
        gone = same.select("leaf", "masked").union(near.select("leaf", "masked"))
        stay = written(own.join(gone, ["leaf", "masked"], "left_anti"))
        split = F.xxhash64("node", "place", F.get("t", F.col("place")))
        # A node whose lines are all alike has too few documents, and isn't split further.
        left, k = written(stay.join(_telling(stay), "node").select("leaf", split.alias("node"), "masked", "n_docs")), k + 1
    return reduce(DataFrame.union, out) if out else None


def recurring_lines(docs: DataFrame, least_docs: int = 10, depth: int = 3, least_tokens: int = 1, agree_percent: int = 75, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, drop``: the line numbers, from 0, that repeat a template which ``least_docs`` documents have.

    The tree has a level for the number of tokens and ``depth`` levels for the
    leading tokens.  A leaf's template is the masked line that most of its
    documents have (the largest of equals); lines that agree with it at
    ``agree_percent`` % of their positions or more belong to it, and where they
    differ it is variable.  If too few documents have it, and for the other
    lines, further templates of the leaf are looked for.  With ``keep_first`` a
    template's first line, by document and place, isn't listed.
    """
    lines = _lines(docs, id_col, text_col, depth, least_tokens)
    leaves = written(_documents(lines, "leaf").where(F.col("n_docs") >= least_docs).select("leaf"))
    few = leaves.count() <= BROADCAST_ROWS
    found = lines.join(F.broadcast(leaves) if few else leaves, "leaf")
    found = written(found.select("leaf", "doc", "line_no", F.array_join(F.transform("tokens", _masked), " ").alias("masked")))
    groups = written(_documents(found, "leaf", "masked"))
    common = groups.groupBy("leaf").agg(F.max_by("masked", F.struct("n_docs", "masked")).alias("template"))
    own, shared = F.split("masked", " "), F.split("template", " ")
    agree = F.size(F.filter(F.zip_with(own, shared, lambda a, b: a == b), lambda same: same))
    template = F.xxhash64(F.when(100 * agree >= agree_percent * F.size(own), F.col("template")).otherwise(F.col("masked"))).alias("template")
    own = written(groups.join(common, "leaf").select("leaf", "masked", "n_docs", template))
    recur = written(_recurring(found, own.drop("n_docs"), least_docs))
    further = _further_templates(found, own.join(recur, ["leaf", "template"], "left_anti").drop("template"), least_docs, agree_percent)
    of = own.join(recur, ["leaf", "template"], "left_semi").select("leaf", "masked", "template")
    placed = written(found.join(of if further is None else of.union(further), ["leaf", "masked"]).select("leaf", "doc", "line_no", "template"))
    counts = _documents(placed, "leaf", "template").where(F.col("n_docs") >= least_docs).select("leaf", "template")
    if keep_first:
        counts = counts.join(placed.groupBy("leaf", "template").agg(F.min(F.struct("doc", "line_no")).alias("first")), ["leaf", "template"])
    # Both are templates of leaves that least_docs documents have: no more rows than the corpus has lines / least_docs.
    drops = placed.join(counts, ["leaf", "template"])
    drops = drops.where(F.struct("doc", "line_no") != F.col("first")) if keep_first else drops
    return drops.groupBy("doc").agg(F.collect_set("line_no").alias("drop"))


def line_dedup(docs: DataFrame, least_docs: int = 10, depth: int = 3, least_tokens: int = 1, agree_percent: int = 75, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without recurring lines, and ``n_lines`` and ``n_dropped`` (they replace columns of these names).

    Tokens are what single spaces (0x20) separate; lines end at ``\\n``.  Lines
    of fewer than ``least_tokens`` tokens always stay.  Every line of a recurring
    template goes, or with ``keep_first`` all but its first by id and place, so
    that a text which many documents copy isn't lost.  A null text stays null,
    with no lines; a row with a null id keeps its lines and isn't counted; rows
    that repeat an id count as one document and lose the same line numbers; a
    text whose every line goes becomes empty; an empty table gives no rows.  Of
    equally frequent masked lines the largest is a leaf's first template.
    """
    drops = recurring_lines(docs, least_docs, depth, least_tokens, agree_percent, keep_first, id_col, text_col).withColumnsRenamed({"doc": "_dedup_doc", "drop": "_dedup_drop"})
    lines = F.split(F.col(text_col), "\n")
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dedup_drop"))
    # The array around the lines binds them to all_lines, so that a text is split once and not once a line.
    left = F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda k: F.get(all_lines, k)), "\n"))
    kept = F.when(F.col("_dedup_drop").isNull(), F.col(text_col)).otherwise(F.get(left, F.lit(0)))
    gone = F.when(F.col("_dedup_drop").isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size(stay))
    # By shuffle at any size: a broadcast below some size would only make small runs look cheaper.
    out = docs.join(drops.hint("merge"), F.col(id_col) == F.col("_dedup_doc"), "left")
    return out.withColumns({"n_lines": size.cast("bigint"), "n_dropped": gone.cast("bigint"), text_col: kept}).drop("_dedup_doc", "_dedup_drop")
