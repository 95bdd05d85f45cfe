"""The whole pipeline against a brute-force version on a table with planted cases."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from spectrail.llm import queries

RNG = np.random.default_rng(21)
ENDS = ["ing", "er", "ly", "tion", "ed", "al", "ous", "ness", "ment", "s"]
WORDS = ["".join(RNG.choice(list("bcdfglmnprst"), 1)) + "".join(RNG.choice(list("aeiou"), 1)) + "".join(RNG.choice(list("bcdfglmnprst"), 1)) + ENDS[k % 10] for k in range(600)]


def sentence(n):
    w = RNG.choice(WORDS, n).tolist()
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


def prose(n=12):
    return "\n".join(sentence(int(RNG.integers(6, 14))) for _ in range(n))


def edited(text, edits):
    parts = re.split(r"(\s)", text)
    for k in RNG.choice(len(parts) // 2, edits, replace=False):
        parts[2 * k] = str(RNG.choice(WORDS))
    return "".join(parts)


ITEMS = [(k, prose(3).replace("\n", " ")) for k in range(5)] + [(9, None)]


def corpus():
    clean = [prose(int(RNG.integers(8, 20))) for _ in range(320)]
    for k in range(14):
        clean[k] = f"Licence number {k} of this corpus applies here\n" + clean[k]
    for k in range(5):
        clean[40 + k] += "\n" + ITEMS[k][1]
    base = prose(20)
    near = [base] * 3 + [edited(base, int(e)) for e in RNG.integers(1, 10, 5)]  # fewer than a recurring line needs
    junk = [" ".join(w + "".join(RNG.choice(list("*$&%#"), 3)) for w in RNG.choice(WORDS, 60)) for _ in range(20)]
    junk += [" | ".join(RNG.choice(WORDS, 60)) for _ in range(20)] + [" ".join(w.upper() + "!!" for w in RNG.choice(WORDS, 60)) for _ in range(20)]
    junk += [" ".join([str(RNG.choice(WORDS))] * 60) for _ in range(20)] + [None, "", " \n "]
    texts = clean + near + junk
    order = RNG.permutation(len(texts)).tolist()
    return [(int(i), texts[k], "en" if i % 3 else None, f"s{i % 4}", None if texts[k] is None else len(texts[k])) for i, k in enumerate(order)], {i for i, k in enumerate(order) if k < len(clean) + len(near)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_lines(docs, least=10):
    places = {}
    for i, t in sorted(docs.items()):
        for n, line in enumerate(t.split("\n")):
            tokens = [x for x in line.split(" ") if x]
            if tokens:
                places.setdefault(" ".join("<*>" if re.search("[0-9]", x) else x for x in tokens), []).append((i, n))
    gone = {p for at in places.values() if len({i for i, _ in at}) >= least for p in at if p != min(at)}
    out = {}
    for i, t in docs.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if left.strip(" ") or not any(p[0] == i for p in gone):
            out[i] = left
    return out


def grams(text, n=5):
    w = words(text.lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(docs):
    sets, root = {i: grams(t) for i, t in docs.items()}, {i: i for i in docs}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return {i: t for i, t in docs.items() if root[i] == i}


def test_pipeline_by_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows, good = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = brute_groups(brute_lines({i: t for i, t, *_ in rows if i in good}))
    items = [grams(t) for _, t in ITEMS if t]
    docs = {i: t for i, t in docs.items() if not any(100 * len(x & grams(t)) >= 80 * len(x) for x in items)}
    library = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert len(good) - len(want) >= 5 + 2  # the benchmark's passages and the exact copies at least; a recurring line goes without its document
