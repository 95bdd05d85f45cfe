"""n-gram Jaccard join by vertical partitioning of the global order of shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import BLOBS, bucket_bits, bucketed, leads, planes, table, unpacked, unplanes
from .components import components
from .tables import small_batches, written
from .words import chunks, mix

#: Fragments in which overlaps of a candidate pair are counted apart.
FRAGMENTS = 8
#: Documents in candidate pairs (24 bytes each) up to which they are broadcast to fetch their texts.
BROADCAST_ROWS = 2_000_000
#: Words of 64 bits in a document's coarse parity sketch; the fine one has two bits or more for each shingle, a power of two.
SKETCH = 16
#: Keys that a map task settles and packs at once; it bounds memory and changes no result.
FLUSH = 500_000


def difference_bound(a: int | Column, b: int | Column, percent: int) -> int | Column:
    """Most shingles that two linked sets of these sizes can have apart: union - intersection, times 100 + percent."""
    return (100 - percent) * (a + b)


class Classes:
    """Sizes in octaves; each octave has its number of fragments.

    Linked sets whose smaller one lies in octave c differ in at most ``apart``
    shingles, so of more fragments at least one is the same in both.  Some
    fragments of a set can be empty, which tells nothing; ``spare`` more
    fragments allow for that, and a set with more empty ones than that is
    searched by its least shingles instead (see fragments_of).
    """

    def __init__(self, percent: int):
        self.percent = percent

    def of(self, n: int) -> int:
        return max(0, n.bit_length() - 1)

    def cut(self, c: int) -> tuple[int, int]:
        most = (2 << c) - 1  # size of the smaller set
        larger = most * 100 // self.percent
        apart = (100 - self.percent) * (most + larger) // (100 + self.percent)
        spare = 2 + apart // 50
        return apart + 1 + spare, spare

    def searched(self, n: int) -> list[int]:
        """The octave of a set, and the one below if its partner can lie there; none for a set so small that it links with its equals only."""
        if 100 * n < self.percent * (n + 1):  # the nearest other set has one shingle more
            return []
        c = self.of(n)
        return [c] + ([c - 1] if c and self.percent * n <= 100 * ((1 << c) - 1) else [])


def fragments_of(hashes: np.ndarray, c: int, classes: Classes) -> np.ndarray:
    """Keys of one set (its sorted hashes) in octave c.

    The global order of shingles is that of their hashes, cut into equal
    ranges; a key hashes all that a set has in one range.  A set with too many
    empty ranges adds keys of its least shingles: two linked sets that both
    have too many share one of their first n - ceil(n * percent / 100) + 1.
    """
    ranges, spare = classes.cut(c)
    part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
    edges = np.flatnonzero(np.diff(part, prepend=np.uint64(ranges)))
    ends = np.append(edges[1:], len(hashes))
    keys = mix(mix(sums[ends] - sums[edges]) + part[edges] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
    if ranges - len(edges) > spare:
        n = len(hashes)
        first = n - -(-n * classes.percent // 100) + 1
        keys = np.concatenate([keys, mix(hashes[:first] ^ np.uint64(0xA0761D6478BD642F + c))])
    return keys


_SIGNED = pa.int64()


def _parity(h: np.ndarray) -> np.ndarray:
    """Of each bit whether an odd number of hashes falls on it."""
    bits = max(64 * SKETCH, 2 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signatures(n: int, percent: int, with_keys: bool):
    """Size and hashes of each document's set, with its fragments' keys or its parity sketch."""
    classes = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                row, h = c.shingles(n)
                cuts = np.searchsorted(row, np.arange(c.rows + 1))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
                xors = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(mix(h ^ np.uint64(0x2545F4914F6CDD1D)))]) if len(h) else np.zeros(1, np.uint64)
                each = zip(cuts, cuts[1:], strict=False)
                if with_keys:
                    lists = [np.concatenate([h[:0], *(fragments_of(h[lo:hi], o, classes) for o in classes.searched(int(hi - lo)))]).view(np.int64) for lo, hi in each]
                else:
                    lists = [_parity(h[lo:hi]) for lo, hi in each]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.row, c.rows), pa.array(np.diff(cuts), _SIGNED), pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)), pa.array((xors[cuts[1:]] ^ xors[cuts[:-1]]).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), _SIGNED))],
                    ["doc_id", "n_shingles", "sum_hash", "xor_hash", "list"],
                )

    return run


def _firsts(h: np.ndarray, doc: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By key: each set's least document; and the number of sets with the same key."""
    x = np.lexsort((doc, sign, h))
    h, doc, sign = h[x], doc[x], sign[x]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (sign[1:] != sign[:-1])
    h, doc, sign = h[first], doc[first], sign[first]
    count = np.diff(np.append(np.flatnonzero(leads(h) == np.arange(len(h))), len(h)))
    return h, doc, sign, np.repeat(count, count)


def _shared(n: int, percent: int, bits: int, spread: int):
    """The keys of documents, packed by bucket; and of a bucket, the keys that two sets or more have, each with the least document of each set.

    Exact copies are dropped within a flush.  A key that two sets of a flush
    have is known to be shared: those rows need no bucket and go to one of
    ``spread`` others, and one of them stands for the flush in the key's
    bucket.  So a hot key's bucket has a row for each flush, not for each document.
    """

    def key_of(h: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - bits)
        return (mix(h >> shift << shift) ^ (h & np.uint64((1 << 56) - 1))).view(np.int64)

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, sign, sets = _firsts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        lead = leads(h) == np.arange(len(h))
        many = sets > 1
        rows = bucketed(h[lead], bits, doc[lead], sign[lead], True)
        if many.any():
            rows.append(((1 << bits) + int(h[many][0] % np.uint64(spread)), int(many.sum()), key_of(h[many]).tobytes(), planes(doc[many]), b""))
        for lo in range(0, len(rows), 1000):
            yield from table(rows[lo : lo + 1000]).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in _signatures(n, percent, True)(batches):
            lists = batch.column(4)
            ids, ends = batch.column(0).to_numpy(), lists.offsets.to_numpy()
            h = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
            doc, own = np.repeat(ids, np.diff(ends)), np.repeat(batch.column(2).to_numpy().view(np.uint64), np.diff(ends))
            parts.append((h, doc, mix(own ^ h).view(np.int64)))  # another sign for each key, so that sets can't agree in all
            held += len(h)
            if held >= FLUSH:
                yield from settle(parts)
                parts, held = [], 0
        if held:
            yield from settle(parts)

    def find(group: pa.Table) -> pa.Table:
        doc = np.concatenate([unplanes(x, np.int64) for x in group.column("docs").to_pylist()])
        if group.column("bucket")[0].as_py() >= 1 << bits:
            return pa.table([pa.array(np.concatenate([np.frombuffer(x, np.int64) for x in group.column("keys").to_pylist()])), pa.array(doc)], names=["key", "doc"])
        h = np.concatenate([unpacked(x) for x in group.column("keys").to_pylist()])
        sign = np.concatenate([unplanes(x, np.int64) for x in group.column("starts").to_pylist()])
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[1:] = h[order][1:] == h[order][:-1]
        again[:-1] |= again[1:]
        x = order[again]
        h, doc, _, sets = _firsts(h[x], doc[x], sign[x])
        high = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(64 - bits)
        key = (mix(np.array([high])) ^ (h & np.uint64((1 << 56) - 1))).view(np.int64)
        return pa.table([pa.array(key[sets > 1]), pa.array(doc[sets > 1])], names=["key", "doc"])

    return pack, find


def _fragments(n: int):
    """Each wanted document's shingles in FRAGMENTS ranges of the global order; a row whose set isn't the one its id stands for is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for c in chunks(batch.column(1), lower=True):
                row, h = c.shingles(n)
                cuts = np.searchsorted(row, np.arange(c.rows + 1))
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
                part = slice(c.row, c.row + c.rows)
                good = (np.diff(cuts) == sizes[part]) & ((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64) == sums[part])
                row, h = row[good[row]], h[good[row]]
                key = row * FRAGMENTS + (h >> np.uint64(64 - int(math.log2(FRAGMENTS)))).astype(np.int64)
                lo = np.flatnonzero(np.diff(key, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(lo, len(key)), pa.int32()), pa.array(h.view(np.int64), _SIGNED))
                ids = batch.column(0).slice(c.row, c.rows).take(pa.array(row[lo]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key[lo] % FRAGMENTS, pa.int32()), lists], ["doc", "fragment", "shingles"])

    return run


def _coarse(fine: Column) -> Column:
    """The fine sketch folded to SKETCH words."""
    turns = F.sequence(F.lit(0), F.size(fine) - SKETCH, F.lit(SKETCH))
    return F.aggregate(turns, F.array_repeat(F.lit(0).cast("bigint"), SKETCH), lambda t, k: F.zip_with(t, F.slice(fine, k + 1, F.lit(SKETCH)), lambda u, v: u.bitwiseXOR(v)))


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes allow a link, and so do the coarse sketches: they differ in no more bits than the sets in shingles."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(SKETCH)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bits <= difference_bound(na, nb, percent))


def _nearer(a: str, b: str, percent: int) -> Column:
    """The same of the fine sketches; sizes that can link differ by one doubling at most."""
    fine_a, fine_b = F.col(f"{a}.fine"), F.col(f"{b}.fine")
    size = F.least(F.size(fine_a), F.size(fine_b))
    folded = [F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda u, v: u.bitwiseXOR(v))).otherwise(x) for x in (fine_a, fine_b)]
    bits = F.aggregate(F.zip_with(*folded, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, k: t + k)
    return (100 + percent) * bits <= difference_bound(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def _plausible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose sizes and sketches allow a link."""
    p, q = sizes.alias("p"), sizes.alias("q")
    return pairs.join(p, F.col("a") == F.col("p.doc")).join(q, F.col("b") == F.col("q.doc")).where(_near("p", "q", percent) & _nearer("p", "q", percent)).select("a", "b")


def _distances(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, apart, link`` of distinct pairs (a, b): Jaccard distance, and whether they link.  Overlaps are counted in each fragment apart, then summed."""
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = written(wanted.join(sizes, "doc").select("doc", "n", "sum_hash"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # else the texts are shuffled
    parts = docs.join(wanted, docs.doc_id == wanted.doc).select("doc_id", "text", "n", "sum_hash").mapInArrow(_fragments(n), "doc bigint, fragment int, shingles array<bigint>")
    parts = written(parts)
    left, right = parts.withColumnsRenamed({"doc": "a", "shingles": "left"}), parts.withColumnsRenamed({"doc": "b", "shingles": "right"})
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("left", "right")).alias("both"))
    partial = partial.groupBy("a", "b", "fragment").agg(F.max("both").alias("both"))  # rows that repeat an id repeat its fragments
    total = partial.groupBy("a", "b").agg(F.sum("both").alias("both"))
    na, nb = sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb"))
    union = F.col("na") + F.col("nb") - F.col("both")
    return total.join(na, "a").join(nb, "b").select("a", "b", (1 - F.col("both") / union).alias("apart"), (100 * F.col("both") >= percent * union).alias("link"))


def _links(distances: DataFrame) -> DataFrame:
    return distances.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id``.

    Two documents link when their sets of lower-cased (A-Z) n-word shingles have
    a Jaccard similarity of ``percent`` % or more; a text of fewer words has its
    whole sequence as one shingle, a null or empty one has none and links with
    nothing; ``percent`` is 50 to 100.  ``component_id`` is the least id reachable by links.  Rows with a
    null id form no links and get a null component; rows that repeat an id count
    as one document, with the first set by size and hash.

    1. Equal sets are one class, for which the least id stands.
    2. The order of shingles is cut into fragments (see Classes): linked classes
       share a whole fragment.  Only fragments of two classes or more go on.
    3. Within each such fragment all are compared with one class, the one with
       most shared fragments; then classes of different components so far are
       compared with each other, if size, parity sketch and their distances to
       that one class allow a link (Jaccard distance is a metric).  So all
       links between components are found, and a group of near copies isn't
       expanded into all its pairs.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"a similarity of {percent} % isn't searched for: sets of more than twice a set's size would be its partners")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    fields = "doc_id bigint, n_shingles bigint, sum_hash bigint, xor_hash bigint, list array<bigint>"
    signed = written(known.mapInArrow(_signatures(n, percent, False), fields))
    each = signed.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "sum_hash", "xor_hash")).alias("same"))
    full = each.where("same.n_shingles > 0")
    classes = full.groupBy("same").agg(F.min("doc_id").alias("rep"))
    members = full.join(classes, "same").select("doc_id", "same", "rep")
    members = written(members.unionByName(each.where("same.n_shingles = 0").select("doc_id", "same", F.col("doc_id").alias("rep"))))

    size = signed.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack, find = _shared(n, percent, bucket_bits(docs.sparkSession, size / 2), max(parts, size // (8 * FLUSH)))  # a set has about half as many keys as shingles
    shared = written(known.mapInArrow(pack, BLOBS).groupBy("bucket").applyInArrow(find, "key bigint, doc bigint").distinct())
    own = classes.select(F.col("rep").alias("doc"), "same")
    mine = signed.select(F.col("doc_id").alias("doc"), F.struct("n_shingles", "sum_hash", "xor_hash").alias("same"), F.col("list").alias("fine"))
    sizes = own.join(shared.select("doc").distinct(), "doc").join(mine, ["doc", "same"]).select("doc", F.col("same.n_shingles").alias("n"), F.col("same.sum_hash").alias("sum_hash"), "fine", _coarse(F.col("fine")).alias("sketch"))
    sizes = written(sizes.dropDuplicates(["doc"]))

    weight = shared.groupBy("doc").agg(F.count("*").alias("weight")).join(sizes, "doc").select("doc", (F.col("weight") / F.col("n")).alias("weight"))
    centre = written(shared.join(weight, "doc").groupBy("key").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("centre")))
    star = shared.join(centre, "key").where("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
    star = written(_plausible(star, sizes, percent))
    near = written(_distances(star, known, sizes, n, percent))
    links = _links(near)
    found = written(components(links))

    placed = shared.join(found, shared.doc == found.vertex, "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    # Each document's distance to its key's centre: 0 for the centre itself, null where their sketches already rule a link out.
    apart = near.select(F.col("a").alias("doc"), F.col("b").alias("centre"), "apart").unionByName(near.select(F.col("b").alias("doc"), F.col("a").alias("centre"), "apart"))
    rest = placed.join(open_keys.join(centre, "key"), "key").join(apart, ["doc", "centre"], "left")
    rest = rest.join(sizes.drop("fine"), "doc").select("key", "doc", "component", F.when(F.col("doc") == F.col("centre"), 0.0).otherwise(F.col("apart")).alias("apart"), "n", "sketch")
    p, q = rest.alias("p"), rest.alias("q")
    reach = F.abs(F.col("p.apart") - F.col("q.apart")) <= 1 - percent / 100 + 1e-9
    across = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & F.coalesce(reach, F.lit(True)) & _near("p", "q", percent))
    across = across.select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).distinct()
    across = written(_plausible(across.join(star, ["a", "b"], "left_anti"), sizes, percent))
    links = written(links.unionByName(_links(_distances(across, known, sizes, n, percent))))
    found = components(links).select(F.col("vertex").alias("rep"), "component")
    result = members.join(found, "rep", "left").select("doc_id", F.col("same.n_shingles").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    counted = rows.select("doc_id").join(result, "doc_id", "left")
    return counted.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id")
