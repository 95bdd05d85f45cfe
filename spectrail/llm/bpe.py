"""Byte-level BPE by speculation: greedy longest match proposes, checks of adjacent pairs verify, exact merges mend the rest."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

#: The byte-level pre-tokenizer's pattern (a fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose tokens a worker keeps, and their characters; beyond either the store starts anew.
KEPT_WORDS, KEPT_CHARS = 400_000, 8_000_000
#: Bytes of a word from which on its merges are done one by one from a heap, and not in rounds over many words at once.
LONG_WORD = 1000


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """One vocabulary, with tables for whole arrays of token pairs."""

    def __init__(self, spec: str):
        stated = json.loads(spec)
        model, byte_of = stated["model"], _byte_of()
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in stated.get("added_tokens", [])}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        # rank: when a token can first come about; single bytes come before every merge.
        self.rank = np.zeros(size, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i, j, to = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.merge[i, j] = (k + 1, to)
            if self.left[to] < 0 and len(a + b) > 1:
                self.rank[to], self.left[to], self.right[to] = k + 1, i, j
        keys = np.array([i << 32 | j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank, self.pair_to = (np.array(x, np.int64)[order] for x in zip(*self.merge.values(), strict=True))
        self.reach: dict[bytes, int] = {}  # bytes of the longest token with these three in front
        for b in self.id_of:
            self.reach[b[:3]] = max(len(b), self.reach.get(b[:3], 2))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.store: dict[str, bytes] = {}
        self.chars = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does encoding their joined bytes give just the two?

        Undo the later of the two tokens' merges, again and again, and see whether
        at the seam a merge was possible that ranks before the one undone.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        bound = np.full(len(a), np.iinfo(np.int64).max)  # merges from this rank on come too late to join the two
        while len(live):
            keys = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == keys) & (self.pair_rank[at] < bound)
            good[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & (np.maximum(ra, rb) > 0)
            a, b, ra, rb, live = a[go], b[go], ra[go], rb[go], live[go]
            undo_a = ra > rb  # of equal merges the left one happened first, so the right one is undone first
            bound = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words at once: in each, the pair of least rank, wherever it stands, from the left."""
        ids = np.array([self.id_of[bytes([b])] for b in range(256)])[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = len(self.merge) + 1
        while len(ids):
            keys = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.full(len(ids), never)
            rank[:-1] = np.where((self.pair_keys[at] == keys) & (owner[1:] == owner[:-1]), self.pair_rank[at], never)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(ids)))
            ended = least == never
            done.append((owner[ended], ids[ended]))
            pick = np.flatnonzero((rank == least) & ~ended)
            turn = np.arange(len(pick))  # of a run of the same pair, every other one
            turn -= np.maximum.accumulate(np.where(np.diff(pick, prepend=-2) != 1, turn, 0))
            pick = pick[turn % 2 == 0]
            ids[pick] = self.pair_to[np.searchsorted(self.pair_keys, ids[pick] << 32 | ids[pick + 1])]
            stay = ~ended
            stay[pick + 1] = False
            ids, owner = ids[stay], owner[stay]
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def merged_alone(self, word: bytes) -> np.ndarray:
        """Exact merging of one long word: the pair of least rank, of equals the leftmost, from a heap."""
        ids = [self.id_of[bytes([b])] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(ids) and (found := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = to, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([i for i in ids if i >= 0], "<u4")

    def greedy(self, word: bytes) -> list[int]:
        ids, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.reach.get(word[at : at + 3], 2)), at, -1):
                if (i := self.id_of.get(word[at:end])) is not None:
                    ids.append(i)
                    at = end
                    break
        return ids

    def learn(self, words: list[str]) -> None:
        """Tokens of words not yet in the store."""
        raw = [w.encode() for w in words]
        ids = [self.greedy(w) for w in raw]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
        owner = np.repeat(np.arange(len(ids)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]).tolist()
        self.store.update(zip(words, map(np.ndarray.tobytes, np.split(flat.astype("<u4"), np.cumsum(count)[:-1])), strict=True))
        short = [k for k in wrong if len(raw[k]) < LONG_WORD]
        if short:
            self.store.update((words[k], x.tobytes()) for k, x in zip(short, self.merged([raw[k] for k in short]), strict=True))
        self.store.update((words[k], self.merged_alone(raw[k]).tobytes()) for k in wrong if len(raw[k]) >= LONG_WORD)
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[bytes | list[str]]] = []
        for text in texts:
            out, at = [], 0
            for m in self.special_pattern.finditer(text) if self.special_pattern else ():
                out += [self.pattern.findall(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
                at = m.end()
            parts.append([*out, self.pattern.findall(text[at:] if at else text)])
        new = {w for x in parts for words in x if type(words) is list for w in words if w not in self.store}
        if new:
            if len(self.store) + len(new) > KEPT_WORDS or self.chars > KEPT_CHARS:
                self.store.clear()
                self.chars = 0
                new = {w for x in parts for words in x if type(words) is list for w in words}
            self.learn(list(new))
        look = self.store.__getitem__
        return [b"".join(b"".join(map(look, x)) if type(x) is list else x for x in out) for out in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(spec: str) -> Coder:
    return Coder(spec)


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 200) -> DataFrame:
    """One row for each document: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers in a binary column,
    ``decoded`` is the text they decode to, special tokens included.  The
    strings of added tokens in a text become those tokens.  ``tokenizer`` is the
    path of a byte-level BPE file on the driver; its content goes out with the
    tasks.  A null or empty text has no tokens; a null id stays null; repeated
    rows are each encoded; an empty table gives no rows; other columns, whatever
    their names, aren't read.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                ids = coder.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
