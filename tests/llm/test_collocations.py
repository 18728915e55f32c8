import random
import re
from collections import Counter

import numpy as np
import pytest

from trolley.llm import collocations as C


def brute(rows, least=100, longest=5, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


def got(df):
    rows = [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "ÉTÉ", "İ", "x\x1cy", " ", "z", "and", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(1, 120)):
            words += ["new", "york", "City", "hall"][: rng.choice([2, 3, 4])] if rng.random() < 0.1 else [rng.choices(vocabulary, [40 / (k + 1) for k in range(len(vocabulary))])[0]]
            if rng.random() < 0.1:
                words.append(rng.choice([".", ",", "\n", "\r", "\x0b", "\x0c", "!", "; ", ":", "?"]))
        rows.append((rng.choice(["en", "de", None]), "  ".join(words) + "\t"))
    return rows + [("en", None), ("en", ""), (None, " .. "), ("fr", "one of it"), *[("en", "hot hot hot hot hot hot")] * 60, *[("en", "hot hot of the night")] * 40]


@pytest.mark.parametrize("least", [8, 40])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(C, "FLUSH", 700)
    monkeypatch.setattr(C, "HOT_PAIRS", 60)  # some pairs are spread
    rows = corpus(least)
    docs = spark.createDataFrame([(i, a, b, 1, "x") for i, (a, b) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(5)
    want = brute(rows, least)
    assert got(C.collocations(docs, least, part_bytes=2000)) == want and len(want) > 20
    assert got(C.collocations(docs, least, top=3)) == {w for w in want if w[1] <= 3}


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")).count() == 0


def test_no_language_column_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(C, "PORTION_PIECES", 7)
    text = "alpha beta gamma. alpha beta, " * 3000
    assert got(C.collocations(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == brute([(None, text)])


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    columns = [rng.integers(1, 5, 4000).astype(np.uint64) for _ in range(4)]
    for k in range(2, 4):
        columns[k][rng.random(4000) < 0.3] = 0
    columns[3][columns[2] == 0] = 0
    weights = rng.integers(1, 4, 4000)
    want = Counter()
    for *ids, w in zip(*columns, weights, strict=True):
        for k in range(2, 5):
            if all(ids[:k]):
                want[tuple(map(int, ids[:k]))] += int(w)
    found = list(C.frequent_prefixes(columns, weights, 60, np.zeros(4000, bool)))
    assert {tuple(p): n for p, n in found} == {p: n for p, n in want.items() if n >= 60} and len(found) == len({tuple(p) for p, _ in found})


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(C.collocations(docs)) == brute([(r.lang, r.text) for r in docs.collect()])
