"""Terms found by the trie are those that regular expressions find."""

import random
import re

from trolley.functions import vocabulary as W


def test_thousands_of_terms(spark, tmp_path):
    rng = random.Random(3)
    syllables = ["ka", "mi", "to", "ru", "se", "lo"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    terms = {" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(3000)} | {"m&m's", "coca-cola", "7up", "black & white", "kcc", "new kcc", "kcc new"}
    rows = [("brand" if i % 3 else "category", t.title() if i % 5 else f"  {t} ", i) for i, t in enumerate(sorted(terms))] + [("brand", "KCC", 99), ("brand", "--", 1)]
    spark.createDataFrame(rows, W.VOCABULARY).write.json(f"{tmp_path}/v")
    words = W.scan_vocabulary(spark, f"{tmp_path}/v").cache()
    known = {(r.kind, r.term): r["rank"] for r in words.collect()}
    texts = [" ".join(rng.choice([word(), word().upper(), "M&M's", "Coca-Cola,", "new  kcc new", "7up!", "x7up", "black &  white"]) for _ in range(rng.randrange(25))) for _ in range(80)] + [None, "", " \n\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, title string")
    want = set()
    for i, t in enumerate(texts):
        flat = re.sub(r"\s+", " ", (t or "").lower()).strip()
        for kind, term in known:
            if term in flat:
                want |= {(i, kind, term, known[kind, term], m.start(), m.start() + len(term)) for m in re.finditer(rf"(?<!\w)(?={re.escape(term)}(?!\w))", flat)}
    got = [tuple(r) for r in W.find_terms(df, "id", "title", words).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    pairs = {r.id: (r.brand, r.category, r.subcategory) for r in W.brand_and_category(df, "id", "title", words).collect()}
    assert len(pairs) == len(texts)
    for i in range(len(texts)):
        brands = sorted((a, -len(t), t) for j, k, t, _, a, _ in want if j == i and k == "brand")
        kinds = {(t, r) for j, k, t, r, *_ in want if j == i and k == "category"}
        best = min(kinds, key=lambda x: (-len(x[0]), x[1]))[0] if kinds else None
        others = [t for t, r in sorted(kinds, key=lambda x: x[1]) if best not in t and t not in best]
        assert pairs[i] == (brands[0][2] if brands else None, best, others[0] if others else None)
    assert W.find_terms(df, "id", "title", words.limit(0)).count() == 0


def test_nothing_that_grows_with_the_texts_is_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([("brand", "red", 1), ("brand", "red cup", 2), ("category", "cup", 3)], W.VOCABULARY)
    texts = spark.range(300).selectExpr("id", "concat('A ', if(id % 3 = 0, 'red cup', 'cup'), ' no ', id) as title")
    rows = lambda: sorted(map(tuple, W.find_terms(texts, "id", "title", words).collect()))
    few = rows()
    monkeypatch.setattr(W, "SMALL_ROWS", 0, raising=False)
    df = W.find_terms(texts, "id", "title", words)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows() == few and len(few) == 500
    places = W.find_places(texts, "id", "title", words)
    assert {(r.id, r.at, r.term) for r in places.collect()} == {(i, 2, "cup") for i in range(300) if i % 3} | {(i, at, t) for i in range(0, 300, 3) for at, t in ((2, "red"), (2, "red cup"), (4, "cup"))}
