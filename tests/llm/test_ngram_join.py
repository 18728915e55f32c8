import random

import numpy as np
import pyarrow as pa
import pytest

from trolley.llm import ngram_join as N
from trolley.llm.components import components


def brute(rows):
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets)}


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, n long")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_components(docs).collect()}


def test_planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = [word() for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "One  two"), (905, "one two three"), (3, "a b c d e f g"), (2, "a b c d e f g h")]
    for base in range(25):
        n = rng.choice([6, 9, 15, 40, 120, 400])
        text = line + [word() for _ in range(n)]
        for copy in range(rng.choice([1, 2, 5, 25])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, n // 60 + 1])):
                i = rng.randrange(len(own))
                own[i : i + 1] = rng.choice([[], [word()], [own[i], word()]])
            rows.append((1000 + base * 40 + copy, " ".join(own)))
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_short_capacity_goes_through_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "allocation", lambda band: (1, 0))
    rng = random.Random(1)
    text = [str(rng.random()) for _ in range(60)]
    rows = [(i, " ".join(text[:k] + [f"x{i}"] + text[k:])) for i, k in enumerate((0, 3, 20, 30, 60))] + [(9, "p q r s t u v w x y")]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in N.ngram_components(docs).collect()) == [(0, 0, 0), (0, 2, 4), (4, 2, 4), (7, 2, 4)]
    assert {r.doc_id for r in N.keep_one_of_each(docs).collect()} == {None, 4}


def test_rows_that_share_an_id(spark):
    """A node is a text, not an id: no row is lost because another one has its id."""
    a, b, c = "a b c d e f g h i j", "k l m n o p q r", "x " * 20_000 + "y"
    docs = spark.createDataFrame(
        [(3, a, 1), (5, a, 2), (5, b, 3), (None, b + " s", 4), (None, c, 5), (6, b.upper(), 6), (7, a, 7), (7, a, 7)], "doc_id long, text string, stays long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.ngram_components(docs).collect())
    assert got == sorted([("3", 6, "3"), ("5", 6, "3"), ("5", 4, "5"), ("None", 5, "5"), ("None", 2, "None"), ("6", 4, "5"), ("7", 6, "3"), ("7", 6, "3")])
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.stays for r in kept.collect()) == [1, 3, 5]


def test_many_weak_sets(spark):
    """A long passage in sets that differ in the rest: hot segments all over, links found all the same."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(12)}" for _ in range(rng.choice([2, 4, 8, 20]))])) for i in range(400)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("left, most_rounds", [(None, 1), (0, 9)])
def test_rounds_end_once_the_pairs_left_are_few(spark, monkeypatch, left, most_rounds):
    """One round of pivots, then all pairs that are left, if they are few; else as many rounds as it takes, with the same result."""
    if left is not None:
        monkeypatch.setattr(N, "PAIRS_LEFT", left), monkeypatch.setattr(N, "PAIRS_EACH", left)
    rng = random.Random(4)
    passage, base = [f"p{i}" for i in range(40)], [f"c{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(40)}" for _ in range(rng.choice([8, 20, 30]))])) for i in range(200)]
    rows += [(1000 + i, " ".join(base[: 35 + i % 9] + [f"y{i}"] + base[35 + i % 9 :])) for i in range(60)]
    names, plain = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df, name, *a, **k: names.append(name) or plain(df, name, *a, **k))
    assert got(spark, rows) == brute(rows)
    assert 1 <= names.count("ngram-pivots") <= most_rounds


def test_pairs_of_many_buckets_are_made_once(spark):
    """Two sets are a pair if one asks in a bucket that both have, however many these are; the join gives it once where the lists aren't cut."""
    rng = random.Random(2)
    for few, share in ((N.LISTED, 0.6), (60, 0.7)):
        rows = [(b, i, i, rng.random() < 0.3, 50, [0]) for i in range(9) for b in range(few) if rng.random() < share]
        now = spark.createDataFrame(rows, "bucket long, id long, component long, asks boolean, n long, parity array<long>")
        pivots = now.where("id % 2 = bucket % 2")
        asks = {(b, i): a for b, i, _, a, _, _ in rows}
        want = {tuple(sorted((p, i))) for b, p in asks if p % 2 == b % 2 for c, i in asks if b == c and i != p and (asks[b, p] or asks[c, i])}
        got = [tuple(r) for r in N._first_meetings(pivots, now).collect()]
        assert set(got) == want and len(got) <= 2 * len(want)  # each of the two may be the pivot


@pytest.mark.parametrize("sizes", [(64, 65), (128, 140), (300, 300), (500, 520), (1000, 1030)])
def test_parities_never_rule_out_a_link(spark, sizes):
    rng = np.random.default_rng(sizes[0])
    rows = []
    for share in (0.0, 0.5, 0.8, 0.9, 1.0):
        base = rng.integers(0, 1 << 64, sizes[1], dtype=np.uint64)
        a = np.unique(base[: sizes[0]])
        b = np.unique(np.concatenate([base[: int(share * sizes[1])], rng.integers(0, 1 << 64, sizes[1] - int(share * sizes[1]), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        rows.append((len(a), len(b), N.parities(a).tolist(), N.parities(b).tolist(), 100 * both >= 80 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "n long, m long, p array<long>, q array<long>, linked boolean")
    got = df.select("linked", N.close_enough(df.n, df.m, df.p, df.q).alias("close"), N.close_enough(df.m, df.n, df.q, df.p).alias("turned")).collect()
    assert all(r.close == r.turned and (r.close or not r.linked) for r in got) and not got[0].close and any(r.linked for r in got)


@pytest.mark.parametrize("n", [5, 12, 33, 100, 400])
def test_capacity_finds_close_sets(n):
    """Whatever two linked sets differ in, they share a signature."""
    rng = np.random.default_rng(n)
    for _ in range(60):
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        other = n + rng.integers(0, n // 4 + 1)
        differ = (n + other) // 9
        keep = (n + other - differ) // 2
        a = np.unique(base)
        b = np.unique(np.concatenate([base[:keep], rng.integers(0, 1 << 64, other - keep, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        s = N.Signatures()
        s.add(a, 2), s.add(b, 4)
        sigs, ids, capacity = s.made()
        assert capacity[0] >= N.needed(len(a))
        assert set(sigs[ids >> np.uint64(1) == 1].tolist()) & set(sigs[ids >> np.uint64(1) == 2].tolist())


def test_signatures_are_sent_in_few_bytes():
    """40 bits a signature, and for each set its id and two counts, however many signatures it has there."""
    rng = np.random.default_rng(7)
    sigs = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    blob = N._packed_sigs(sigs)
    assert len(blob) == 5 * len(sigs)
    assert (N._unpacked_sigs(pa.py_buffer(blob)) == sigs & np.uint64((1 << 40) - 1)).all()
    for most in (3, 300, 70_000):
        ids = np.sort(np.repeat(rng.integers(0, 1 << 64, 20, dtype=np.uint64), rng.integers(1, most + 1, 20)))
        blob = N._packed_ids(ids)
        assert (N._unpacked_ids(pa.py_buffer(blob)) == ids).all()
        assert len(blob) <= 8 + 20 * (8 + 2 * 4)


def test_components_of_many_portions(spark, monkeypatch):
    monkeypatch.setattr("trolley.llm.components.PORTION", 5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 9), (9, 5), (3, 3)], "u long, v long").repartition(4)
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(10, 41), 10), 1: 1, 9: 1, 5: 1}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(1, 9), (9, 5), (3, 3)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(10, 61), 10), 1: 1, 9: 1, 5: 1}
