"""The fuzzy index finds what comparing everything finds."""

import random

import pytest
from pyspark.sql import functions as F

from trolley.functions import scores as S
from trolley.operators import fuzzy, search


def texts(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices(alphabet, k=k))
    out = set()
    while len(out) < n:
        base = word(rng.choice([1, 2, 3, 5, 6, 8, 9, 11, 13, 16, 20, 27, 40, 66, 90]))
        out.add(base)
        for _ in range(3):
            edited = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 4 + 1))):
                at = rng.randrange(len(edited) + 1)
                edited[at : at + rng.randrange(2)] = word(rng.randrange(2))
            out.add("".join(edited))
        a, b = sorted(rng.choices(range(len(base) + 1), k=2))
        out |= {base[a:b], base + word(len(base) // 3), word(2) + base}
    return sorted(x for x in out if x and not x.isspace())


@pytest.mark.parametrize("threshold, alphabet", [(0.6, "abeé -tu"), (0.75, "abeé -tu"), (0.9, "aab1"), (0.57, "kmrao ")])
def test_index_loses_nothing(spark, threshold, alphabet):
    q = spark.createDataFrame([(x,) for x in texts(1, 150, alphabet)], "asked string").select(F.lower(F.trim("asked")).alias("asked")).where("asked <> ''").distinct().cache()
    t = spark.createDataFrame([(x,) for x in texts(1, 220, alphabet) + texts(2, 200, alphabet)], "term string").distinct().cache()
    asked, term = F.col("asked"), F.col("term")
    score = S.combined_match_score(S.string_similarity(asked, term), S.phonetic_score(asked, term), asked == term, F.lit(False))
    want = {(r.asked, r.term) for r in q.crossJoin(t).where(score >= threshold).collect()}
    found = fuzzy.candidates(q.withColumn("asked_sounds", S.sounds(asked)), t.withColumn("term_sounds", S.sounds(term)), threshold, 2)
    got = {(r.asked, r.term) for r in found.collect()}
    assert want <= got and len(want) > 100
    silent = {(r.asked, r.term) for r in q.crossJoin(t).where((score >= threshold) & (S.phonetic_score(asked, term) == 0)).collect()}
    assert silent or threshold > 0.7


def test_no_cross_join(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW_PAIRS", 0)
    q = spark.createDataFrame([(1, "sandwch bread")], "query_id long, text string")
    t = spark.createDataFrame([(1, "sandwich bread", "name")], "product_id long, term string, term_type string")
    df = search.fuzzy_cross_match(q, t)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and df.count() == 1
    assert fuzzy.indexed(0.6) and not fuzzy.indexed(0.3)


def test_copies_are_compared_once(spark, monkeypatch):
    names = ["milk", "milks", "mlik", "bread", "sandwich bread", "tea"]
    products = [(i, names[i % 6], f"brand {i % 2}") for i in range(60)]
    terms = spark.createDataFrame([(i, t, kind) for i, name, brand in products for t, kind in ((name, "name"), (brand, "brand"))], "product_id long, term string, term_type string")
    texts = ["mlk", "Bread ", "sandwch bread", "brand 1", "zzz"]
    queries = spark.createDataFrame([(i, texts[i % 5]) for i in range(20)], "query_id long, text string")
    plain = [tuple(r) for r in search._best_terms(queries, terms, 0.3).select("query_id", "product_id", "score", "matched_term").collect()] if hasattr(search, "_best_terms") else []
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    seen = []
    compare = search._all_pairs
    monkeypatch.setattr(search, "best_per_key", lambda df, by, order, real=search.best_per_key: seen.append(df.count()) or real(df, by, order))
    assert rows(search.fuzzy_cross_match(queries, terms, 0.3), "query_id", "product_id", "score", "matched_term") == sorted(plain) and compare
    assert max(seen) <= 5 * 6 * 2  # texts x kinds of products x terms
    good = [r for r in plain if r[2] >= 0.6]
    assert rows(search.best_scores(queries, terms), "query_id", "product_id", "score") == sorted(r[:3] for r in good)
    best = {q: min((-s, p) for a, p, s, _ in good if a == q) for q, *_ in good}
    assert rows(search.find_product(queries, terms), "query_id", "product_id") == sorted((q, p) for q, (_, p) in best.items())
    top = sorted((q, p) for q in best for _, p in sorted((-s, p) for a, p, s, _ in good if a == q)[:5])
    prices = spark.createDataFrame([(0, 1.0, 1)], "product_id long, price_kes double, store_id long")
    assert rows(search.find_product_matches(queries, terms, prices), "query_id", "product_id") == top
    near = {(q, t): s for q, _, s, t in plain if s < 0.8}
    want = sorted((q, t) for q in range(20) for _, t in sorted((-s, t) for (a, t), s in near.items() if a == q)[:5])
    assert rows(search.suggest_corrections(queries, terms), "query_id", "matched_term") == want
