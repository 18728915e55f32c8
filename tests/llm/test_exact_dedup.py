import hashlib
import re

from trolley.llm import exact_dedup as D


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    keep = {body: min(g)[3] for body, g in groups.items()}
    out = []
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        out.append((doc_id, keep[body], len(groups[body]), doc_id == keep[body] and -len(text or "") == min(groups[body])[0], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\x0b"), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (None, "lone"), (9, "lone "), (10, "x" * 200_000), (11, "x" * 199_999 + " x")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "k") for d, t in ROWS], "doc_id long, text string, digest string").repartition(4)
    assert sorted([tuple(r) for r in D.exact_groups(docs).collect()], key=str) == brute(ROWS)
    assert D.exact_groups(docs.limit(0)).count() == 0
    kept = D.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "6", "7", "8", "9", "11"])


def test_batch_after_batch(spark, monkeypatch):
    """An index that batches are appended to says the same as one batch, and runs whose filter rules a batch out are not read."""
    rows = [(i, f"text {i % 70}" + " " * (i % 3)) for i in range(500)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    index = D.DigestIndex()
    for k in range(6):
        index = index.append(whole.where(f"doc_id % 6 = {k}"))
    assert [r.level for r in index.runs] == [1, 0, 0]
    seen = lambda df: {(bytes(r.digest), r.best.doc_id, r.group_size) for r in df.collect()}
    assert seen(index.groups()) == seen(D.DigestIndex().append(whole).groups()) and index.groups().count() == 70
    new = D.entries(spark.createDataFrame([(900, "te xt1"), (901, "never seen")], "doc_id long, text string"))
    assert [(r.best.doc_id, r.group_size) for r in index.held(new).collect()] == [(71, 8)]
    assert index.held(D.entries(spark.createDataFrame([(1, "unknown")], "doc_id long, text string"))) is None


def test_query_goes_through_runs_filters_and_compaction(spark, monkeypatch):
    rows = [(i, f"text {i % 470}" + " " * (i % 3)) for i in range(500)] + [(900 + i, "hot one") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    level0, index = D.indexed(docs, run_rows=80)
    assert level0.count() == 700 and [r.level for r in index.runs] == [1, 1, 0]
    w = index.work
    assert (w.flushed, w.compacted) == (9, 2) and w.carried_rows > 300 and 0 < w.merged_rows < 150
    repeated = {r.best.doc_id: r.group_size for r in index.repeated().collect()}
    assert repeated == {**{(i if i % 3 > (i + 470) % 3 or i % 3 == (i + 470) % 3 else i + 470): 2 for i in range(30)}, 900: 200}
    assert index.groups().count() == 471
    monkeypatch.setattr(D, "indexed", lambda docs, f=D.indexed: f(docs, 80))
    assert sorted([tuple(r) for r in D.exact_groups(docs).collect()], key=str) == brute(rows)


def test_hot_digests_go_apart(spark, monkeypatch):
    monkeypatch.setattr(D, "PORTION", 7)
    rows = [(i, "all the same") for i in range(60)] + [(100 + i, f"pair {i // 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted([tuple(r) for r in D.exact_groups(docs).collect()], key=str) == brute(rows)


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(None, "ab"), (None, "ab"), (2, "c"), (2, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in D.exact_groups(docs).collect()) == [("2", False), ("2", True), ("None", False), ("None", True)]


def test_different_texts_of_one_digest_part(spark, monkeypatch):
    """With a digest that collides, byte verification still tells the texts apart."""
    real = D.F.sha2
    monkeypatch.setattr(D.F, "sha2", lambda col, bits: D.F.substring(real(col, bits), 1, 2))
    rows = [(i, f"text {i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_groups(docs).collect()}
    assert got == {i: (i % 50, 6, i < 50) for i, _ in rows}


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: a copy takes no other text of its id along, and equal rows leave one."""
    rows = [(None, "X"), (None, "Y"), (7, "Y "), (None, "Z"), (None, "Z"), (5, "P"), (5, "Q"), (4, "Q "), (6, "R"), (6, "R"), (6, " R"), (6, "S"), (8, "S"), (9, None), (9, "")]
    want = [(None, "X"), (7, "Y "), (None, "Z"), (5, "P"), (4, "Q "), (6, " R"), (6, "S")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, digest string").repartition(4)
    kept = D.drop_copies(docs)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(want) + 1
    assert sorted((str(x) for x in got if x[1]), key=str) == sorted(map(str, want)) and [d for d, t in got if not t] == [9]
