"""Lexical search, Merkle manifests and language identification against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrail.llm import lexical_search as search
from spectrail.llm.language_id import NONE, language_id, presence, train
from spectrail.llm.lexical_search import lexical_search
from spectrail.llm.merkle_manifest import merkle_manifest

RNG = np.random.default_rng(8)
WORDS = [f"{a}{b}" for a in "stone river cloud paper light glass".split() for b in range(12)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id int, rank string, h int, path string, idx int, tree string, lang_pred int, score string, held_out int"
ODD = [
    None, "", " \n\t!", "stone1", "STONE1 Stone1 stone1", "stone1,river2;river2 ünï stone1ünï", "中文 stone1", "stone11 xstone1 stone1x", "a" * 300_000 + " stone1 " + "b c " * 100_000,
    "stone1 river2 tie", "stone1 river2 tie", "river2\nline\nline", "ÀB stone1 àb", "KK stone1", "stone1 " * 70_000,
]
TEXTS = ODD + [" ".join(RNG.choice(WORDS, int(RNG.integers(1, 80)))) + ("\nlast" if k % 3 else "") for k in range(150)]
ROWS = [(k, t, "en" if k % 4 else None, [None, "", "b", "é", "a"][min(k % 9, 4)], k if k % 5 else None) for k, t in enumerate(TEXTS)]
ROWS += [(None, "stone1 river2", "en", "a", 3), (20, "stone1 stone1", "en", "a", 3), (21, TEXTS[21], "en", "alone", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + (7, "r", 1, "p", 2, "t", 3, "s", 4) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return re.findall(search.TERM, (text or "").translate(str.maketrans(search._UPPER, search._SMALL)))


ITEMS = [(1, "Stone1 river2"), (2, "cloud3 cloud3 cloud4 paper5, stone1!"), (2, "glass7"), (3, None), (4, ""), (5, "nowhere"), (None, "stone1"), (6, " ".join(WORDS)), (7, "ünï àb"), (8, "tie")]


def ranked(rows, items, most):
    of = {}
    for i, t in items:
        if i is not None:
            of.setdefault(i, set()).update(terms(t))
    tf = [(r[0], Counter(terms(r[1]))) for r in rows if r[0] is not None]
    tf = [(d, c) for d, c in tf if c]
    n_docs, n_terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for i, own in of.items():
        scored = []
        for d, c in tf:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c), d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:most])]
    return sorted(out)


@pytest.mark.parametrize("most,block", [(50, 4_000_000), (3, 4_000_000), (7, 40)])
def test_search_is_brute_force(spark, docs, monkeypatch, most, block):
    monkeypatch.setattr(search, "BLOCK_CHARS", block)  # items in several blocks give the same
    monkeypatch.setattr(search, "_PIECE", 1000)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id int, text string, score string")
    got = lexical_search(docs, items, most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == ranked(ROWS, ITEMS, most)


def test_search_settles_often(spark, docs, monkeypatch):
    best = search._Best(2, 3)
    best.room, seen = 10, []
    for d in RNG.permutation(200).tolist():
        s = RNG.integers(0, 9, 2)
        seen += [(i, -int(s[i]), d) for i in range(2) if s[i]]
        best.add(s, d)
    item, doc, score = best.settle()
    assert [(int(i), -int(s), int(d)) for i, d, s in zip(item, doc, score, strict=True)] == [x for i in range(2) for x in sorted(y for y in seen if y[0] == i)[:3]]


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical_search(none, items).collect() == [] == lexical_search(docs, none).collect()
    blank = spark.createDataFrame([(1, None), (2, "  ")], "doc_id bigint, text string")
    assert lexical_search(blank, items).collect() == []


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, arity):
    """The top, and each node's siblings as (left, right) up to it."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % arity : i - i % arity + arity]
            steps[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            at[k] = i // arity
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], steps


def manifest(rows, change, arity):
    leaf = lambda doc_id, text, lang, source, n: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0, leaf(*r[:5])), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[0][2] for x in sorted(groups[s], key=lambda x: x[0])], arity) for s in order]
    root, upper = tree([t[0] for t in trees], arity)
    out = []
    for s, (sub, steps), top in zip(order, trees, upper, strict=True):
        for (key, r), own in zip(sorted(groups[s], key=lambda x: x[0]), steps, strict=True):
            text = r[1].replace("\n", "") if r[1] and r[0] is not None and change(r[0]) else r[1]
            fold = leaf(r[0], text, *r[2:5])
            for lefts, rights in own + top:
                fold = sha(lefts, fold, rights)
            out.append((r[0], key[2], sub, root, sha(*(x for step in own + top for x in step)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [3, 2, 5])
def test_manifest_is_brute_force(docs, arity):
    now = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = sorted((tuple(r) for r in merkle_manifest(docs, now=now, arity=arity).collect()), key=str)
    assert got == manifest(ROWS, lambda k: zlib.crc32(str(k).encode()) % 2 == 0, arity)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28])
def test_manifest_of_one_group(spark, n):
    rows = [(k, f"text {k % 2}", "en", "one", 4) for k in range(n)]
    got = merkle_manifest(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest(rows, lambda k: False, 3)


def test_manifest_of_nothing(none, docs):
    assert merkle_manifest(none).collect() == [] and merkle_manifest(none).columns == merkle_manifest(docs).columns


def speech(seed, n):
    """Texts of three made-up languages, whose syllables overlap."""
    rng, out = np.random.default_rng(seed), []
    sounds = {"aa": "ba do ke li mu na po".split(), "bb": "ba do sch ein ung lich po".split(), "cc": "éa ño ke çi mu lla po".split()}
    for k in range(n):
        lang = sorted(sounds)[k % 3]
        out.append((k, " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(int(rng.integers(2, 60)))), lang))
    return out


def test_languages_held_out(spark):
    rows = spark.createDataFrame(speech(1, 900), "doc_id int, text string, lang string").repartition(4)
    got = language_id(rows, most_rows=300, most_landmarks=30).toPandas()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all() and list(got.columns) == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]


def test_language_is_learned_from_allowed_rows_only(spark):
    known = spark.createDataFrame(speech(2, 300), "doc_id int, text string, lang string")
    other = known.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "never").otherwise(F.col("lang")))
    rows = lambda df: sorted(map(tuple, language_id(df).select("doc_id", "lang_pred", "score").collect()))
    assert rows(known) == rows(other)
    for a, b in zip(rows(known), rows(known.repartition(5)), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_kernel_is_brute_force(spark):
    """Scores of a model by n-gram sets of bytes, without places or matrices; collisions of 17 bits are few in these texts."""
    rows = spark.createDataFrame(speech(3, 60), "doc_id int, text string, lang string")
    model = train(rows, most_rows=60, most_landmarks=6)
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t.encode()) - n + 1)}
    sets = [grams(t) for _, t, _ in speech(3, 60)]
    bits = np.concatenate(list(presence(pa.array([t for _, t, _ in speech(3, 60)]))))[:, model.places]
    marks = [sets[int(np.flatnonzero((bits == own).all(1))[0])] for own in model.landmarks]
    got = {r["doc_id"]: r for r in language_id(rows, model).collect()}
    for k, own in enumerate(sets):
        values = np.array([len(own & m) / math.sqrt(len(own) * len(m)) for m in marks]) @ model.weights
        assert abs(got[k]["score"] - np.clip((1 + values.max()) / 2, 0, 1)) < 0.01


def test_language_of_odd_texts(spark, none):
    rows = speech(4, 90) + [(900, None, "aa"), (901, "", "bb"), (902, "12 !! 中", None), (903, "12 !! $", "cc"), (None, "badoke", "aa"), (904, "ba " * 400_000, "aa"), (904, "ba " * 400_000, "aa")]
    docs = spark.createDataFrame([r + (3, "s", 1, "x") for r in rows], "doc_id int, text string, lang string, score int, lang_pred string, held_out int, bits string")
    got = language_id(docs).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got}
    assert [(of[k]["lang_pred"], of[k]["score"]) for k in (900, 901, 903)] == [(NONE, 0.0)] * 3
    assert of[902]["lang_pred"] in ("aa", "bb", "cc") and of[None]["held_out"] is False and of[904]["lang_pred"] == "aa"
    assert language_id(none).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_id(unlabelled).collect()} == {(NONE, 0.0)}
    one = language_id(docs.where("lang = 'aa'")).collect()
    assert {r["lang_pred"] for r in one} == {"aa", NONE}
