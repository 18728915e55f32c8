import random

from trolley.llm import decontaminate as D


def brute(docs, items, threshold=0.8):
    def runs(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    out = set()
    for d, t in docs:
        words = D.plain_words((t or "").encode())
        for i, x in items:
            own = D.plain_words((x or "").encode())
            k = min(5, len(own))
            if k and len(runs(own, k) & runs(words, k)) >= threshold * len(runs(own, k)):
                out.add((d, i))
    return out


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in D.find_leaks(d, i, **more).collect()}, d, i


def test_planted(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 9, 15, 30, 60, 150, 400] * 3)] + [(100, "two words"), (101, ""), (102, None), (103, "one")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 3000)))) for k in range(30)]
    for k, text in items[:24]:
        for share in (1.0, 0.9, 0.5):
            own = text.split()
            own = own[: max(1, int(share * len(own)))]
            at = rng.randrange(1, 2000)
            docs.append((1000 + len(docs), " ".join([word() for _ in range(at)] + [w.upper() + "," for w in own] + [word() for _ in range(rng.randrange(2000))])))
    docs += [(5000, "here are two words."), (5001, None), (5002, ""), (None, items[4][1]), (5003, "one")]
    found, d, i = got(spark, docs, items)
    assert found == brute(docs, items)
    assert got(spark, docs, items, block_bytes=2000)[0] == found
    kept = D.drop_leaks(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in found}
    assert D.find_leaks(d, i.limit(0)).count() == 0 and D.find_leaks(d.limit(0), i).count() == 0


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(spark, docs, items)[0] == brute(docs, items)


def test_short_items_are_never_missed(spark):
    """Items of five to eight words, verbatim anywhere in a document, at its start and its end."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(5 + k % 4))) for k in range(120)]
    docs = []
    for k, text in items:
        before, after = rng.choice([(0, 200), (200, 0), (150, 150)])
        docs.append((k, " ".join([*(word() for _ in range(before)), text, *(word() for _ in range(after))])))
    assert got(spark, docs, items)[0] == brute(docs, items) >= {(k, k) for k, _ in items}


def test_recall_just_at_the_threshold(spark):
    """Items of which 0.8 of the shingles are left, in pieces far apart: at least 0.9 of them are found, and nothing wrong."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(k, " ".join(word() for _ in range(rng.choice([20, 40, 80, 200, 500])))) for k in range(150)]
    docs = []
    for k, text in items:
        own = text.split()
        n = len(own) - 4
        cut = n // 5  # the shingles that go
        docs.append((k, " ".join([*(word() for _ in range(100)), *own[: len(own) - cut], *(word() for _ in range(300))])))
    found, want = got(spark, docs, items)[0], brute(docs, items)
    assert len(want) == 150 and found <= want and len(found) >= 0.9 * len(want)


def test_ids_of_other_types_and_a_very_long_text(spark):
    item = "seven words that are in one document only once"
    d = spark.createDataFrame([(1, "w " * 300_000 + item), (2, "nothing")], "doc_id short, text string")
    i = spark.createDataFrame([(b"k", item)], "item_id binary, text string")
    assert [(r.doc_id, bytes(r.item_id)) for r in D.find_leaks(d, i).collect()] == [(1, b"k")]
