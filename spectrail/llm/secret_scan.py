"""Secrets by pattern, and by novelty: bytes that a string adds to what zstandard makes of its surroundings."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, written

#: Kinds in the order in which spans that start together are listed (fixed values, with the three patterns).
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SENSITIVE = ("passw", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private_key", "privatekey", "access_key", "accesskey", "session", "signature", "akia")
_NEAR = re.compile("|".join(_SENSITIVE), re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_CUT = re.compile(r"=+(?=[^=])")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")


def _sensitive(text: str) -> list[tuple[int, int]]:
    low = text.lower()  # the letters of ASCII among others; the patterns decide
    return [m.span() for m in _NEAR.finditer(text)] if any(w in low for w in _SENSITIVE) else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three patterns, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()  # the letters of ASCII among others; the patterns decide
    if any(w in low for w in _ASSIGNED):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _values(text: str, reach: int) -> list[tuple[int, int]]:
    """Candidates near sensitive words: runs, cut behind each = that isn't at their end, so that KEY=VALUE gives the value.  One that holds a sensitive word itself is taken whole if another word precedes it, else what is beside its words."""
    words = _sensitive(text)
    if not words:
        return []
    out, first = [], 0
    for m in _CANDIDATE.finditer(text):
        cuts = [m.start(), *(m.start() + x.end() for x in _CUT.finditer(m.group())), m.end()]
        for lo, end in zip(cuts, cuts[1:]):
            if end < m.end():
                end -= len(text[lo:end]) - len(text[lo:end].rstrip("="))
            while first < len(words) and words[first][1] + reach < lo:
                first += 1
            near = []
            for k in range(first, len(words)):
                if words[k][0] > end + reach:
                    break
                near.append(words[k])
            inside = [w for w in near if w[0] < end and w[1] > lo]
            if near and (not inside or near[0][1] <= lo):
                out.append((lo, end))
            elif inside:
                ends = [lo, *(x for w in inside for x in (max(lo, w[0]), min(end, w[1]))), end]
                for a, b in zip(ends[::2], ends[1::2]):
                    part = text[a:b]
                    out.append((a + len(part) - len(part.lstrip("=+/_.-")), b - (len(part) - len(part.rstrip("+/_.-")) if b < end else 0)))
    return [(lo, end) for lo, end in out if end - lo >= 12]


#: Different words that a task counts before it passes them on; it bounds memory and changes no count.
_HELD = 100_000


def _plain(word: str) -> bool:
    """Short, or of letters only: others may be the secrets themselves."""
    return len(word) < 12 or len(word) <= 40 and word.replace("_", "").isalpha()


def _measured(text: str, reach: int) -> Iterator[str]:
    """The tokens between white space that hold a candidate, each once."""
    last = 0
    for lo, end in _values(text, reach):
        if lo >= last:
            while lo > last and not text[lo - 1].isspace():
                lo -= 1
            last = end
            while last < len(text) and not text[last].isspace():
                last += 1
            yield text[lo:last]


def _identifiers(reach: int, candidate_reach: int):
    """Identifiers of whole texts: their sightings, those in tokens that hold a candidate, and those within reach of a sensitive word."""

    def of(tokens: Counter) -> Counter:
        total: Counter = Counter()
        for token, n in tokens.items():
            for w in _IDENTIFIER.findall(token):
                total[w] += n
        return total

    def rows(every: Counter, measured: Counter, near: Counter) -> pa.RecordBatch:
        total, held = of(every), of(measured)
        words = [w for w in total | near if _plain(w)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (total, held, near))], ["word", "n", "held", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, measured, near = Counter(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                every.update(text.split())
                measured.update(_measured(text, candidate_reach))
                for lo, hi in _sensitive(text):
                    near.update(_IDENTIFIER.findall(text[max(0, lo - reach) : hi + reach]))
                if len(every) > _HELD:
                    yield rows(every, measured, near)
                    every.clear()
                    measured.clear()
                    near.clear()
        yield rows(every, measured, near)

    return run


def identifier_dictionary(docs: DataFrame, text_col: str = "text", size: int = 2000, reach: int = 64, candidate_reach: int = 96) -> bytes:
    """The ``size`` most frequent identifiers of all documents, and behind them, where zstandard finds them cheapest, the ``size`` most frequent ones within ``reach`` characters of a sensitive word; the most frequent last.

    Those that may be the secrets themselves are left out, as a copied document
    would vouch for its own: long ones with a digit, and those of 12 characters
    or more that are seen nowhere but in what is measured.
    """
    counts = docs.select(text_col).mapInArrow(_identifiers(reach, candidate_reach), "word string, n bigint, held bigint, near bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "held", "near")])
    counts = written(counts.where((F.col("n") > 1) & ((F.length("word") < 12) | (F.col("n") > F.col("held")))))
    top = lambda by: [r.word for r in counts.where(F.col(by) > 1).orderBy(F.desc(by), "word").limit(size).collect()]
    return " ".join(w for words in (top("n"), top("near")) for w in reversed(words)).encode()


class Novelty:
    """Marginal compressed bytes against a dictionary and the text around."""

    #: Characters on either side of a sensitive word in which strings are measured.
    REACH = 96

    def __init__(self, dictionary: bytes, reach: int = REACH, level: int = 19):
        primed = zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if primed:
            primed.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False).compress
        self.reach = reach

    def spans(self, text: str, taken: list[tuple[str, int, int]], share: float) -> list[tuple[str, int, int]]:
        """Strings of 12 characters or more within reach on either side of a sensitive word that add ``share`` bytes a character or more and overlap no span taken."""
        out, last, ends = [], 0, []
        starts = sorted(a for _, a, _ in taken)
        for _, _, b in sorted(taken, key=lambda x: x[1]):  # ends[k]: how far the first k + 1 spans reach
            last = max(last, b)
            ends.append(last)
        for lo, end in _values(text, self.reach):
            k = bisect_left(starts, end)
            if k and ends[k - 1] > lo:
                continue
            before, after = text[max(0, lo - self.reach) : lo].encode(), text[end : end + self.reach].encode()
            body = text[lo:end].encode()
            added = len(self.pack(before + body + after)) - len(self.pack(before + after))
            if added >= share * len(body):
                out.append(("novel", lo, end))
        return out


def secret_scan(docs: DataFrame, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text", identifiers: int = 2000) -> DataFrame:
    """One row for each document: ``doc_id, spans`` with kind, start, end and value of each find, by start, then kind.

    Kinds assign, access and hex are patterns; novel are strings near a
    sensitive word that zstandard, primed with the corpus's identifiers, can't
    shrink below ``share`` bytes a character given the text around, whatever
    they consist of.  A null or empty text has no spans; a null id stays null;
    repeated rows are each scanned; spans that start together are ordered by
    kind; an empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    dictionary = identifier_dictionary(docs, text_col, identifiers, candidate_reach=Novelty.REACH)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novelty.spans(text, base, share), key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
