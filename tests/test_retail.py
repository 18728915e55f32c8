"""Small fixtures with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from trolley.functions import scores as S
from trolley.functions import text as X
from trolley.operators import anomaly, graph, mining, search, trust, validate
from trolley.operators.trends import week_of_year
from trolley.plans.registry import QUERIES
from trolley.sources import pages, tables
from trolley.streaming import streams


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_prices_and_flags(spark):
    assert column(spark, ["KES 1,250", "479 KES", "", "abc", "1.2.3", None], X.parse_price) == [1250.0, 479.0, 0.0, 0.0, 0.0, 0.0]
    assert column(spark, ["true", "YES", "1", "false", "no", "0", "maybe", None], validate.to_flag) == [True, True, True, False, False, False, None, None]
    times = column(spark, ["2026-08-04T10:00:00Z", "2026-08-04 10:00:00", "garbage"], validate.to_time)
    assert times[0] == times[1] and times[2] is None


def test_sizes(spark):
    texts = ["milk 2kgs", "1.5kg", "500ML", "half kg", "1L", "quarter litre", "none"]
    assert column(spark, texts, X.extract_size) == [2.0, 1.5, 500.0, 0.5, 1.0, 0.25, None]
    assert column(spark, texts, X.extract_unit) == ["kg", "kg", "ml", "kg", "L", "L", None]
    assert column(spark, ["2kgs of Brookside Milk!", "half kg sugar", "1.5kg"], X.normalize_text_search) == ["2 kg of brookside milk", "0.5 kg sugar", "1.5 kg"]


def test_weeks(spark):
    assert column(spark, ["2023-12-31", "2024-01-01", "2024-01-06", "2024-01-07"], lambda c: week_of_year(c.cast("date"))) == [53, 0, 0, 1]


def test_scores(spark):
    df = spark.createDataFrame([("milk", "milk"), ("milk", "brookside milk"), ("milc", "milk"), ("", "milk"), ("tea", "soap")], "a string, b string")
    got = [round(r.s, 4) for r in df.select(S.string_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == round(0.7 + 0.3 * 4 / 14, 4) and got[2] == 0.85 and got[3] == 0.0 and got[4] < 0.4
    q = spark.createDataFrame([(1.0, "kg", 1000.0, "g"), (1.0, "kg", 950.0, "g"), (1.0, "kg", 1000.0, "ml"), (1.0, "x", 1.0, "x")], "a double, u string, b double, w string")
    assert [r.s for r in q.select(S.quantity_score(F.col("a"), F.col("u"), F.col("b"), F.col("w")).alias("s")).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_category_takes_the_longest(spark):
    words = ("milk", "milk powder", "tea", "flour")
    got = column(spark, ["Milk powder and tea", "milk", "soap"], lambda c: X.extract_category(c, words))
    assert [(r.category, r.subcategory) for r in got] == [("milk powder", "tea"), ("milk", None), (None, None)]


def test_shopping_list(spark):
    got = column(spark, ["I want to buy milk, bread and 2kg sugar", "milk", None], X.meaningful_terms)
    assert {"milk", "bread", "sugar"} <= set(got[0]) and got[1] == ["milk"] and got[2] == []
    assert column(spark, ["buy milk, bread and sugar", "milk", "find sellers fruit", ""], X.message_intent) == ["shopping_list", "single_product", "seller_search", "empty"]


def test_shopping_list_items(spark):
    texts = ["Can you show me prices for Fresh Milk, 2 kg and sandwich bread + salt!", "buy the the the", "12, 500", ""]
    assert column(spark, texts, X.list_items) == [[["fresh", "milk"], ["2", "kg"], ["sandwich", "bread"], ["salt"]], [["the", "the", "the"]], [["12"], ["500"]], []]
    assert column(spark, texts, X.shopping_list_terms) == [["fresh milk", "2 kg", "sandwich bread", "salt", "milk", "sandwich", "bread"], ["the the the"], [], []]
    assert column(spark, texts, X.meaningful_terms)[0] == ["fresh milk", "sandwich bread", "salt", "milk", "sandwich", "bread"]


def test_search_uses_every_part_of_a_query(spark):
    shelf = spark.createDataFrame(
        [(1, "Fresh Milk", "Daima", "milk", 500, "ml", ["maziwa"]), (2, "Fresh Milk", "Daima", "milk", 1000, "ml", ["maziwa"]), (3, "Fresh Milk", "Jogoo", "milk", 500, "ml", ["maziwa"]),
         (4, "White Sugar", "Mumias", "sugar", 1, "kg", ["sukari"]), (5, "Soap", None, None, None, None, None)],
        "product_id long, name string, brand string, category string, size int, unit string, aliases array<string>")
    queries = spark.createDataFrame([(1, "Daima fresh milk 1l"), (2, "daima fresh mlk 500ml"), (3, "sukari 1000 g"), (4, ""), (5, None)], "query_id long, text string")
    found = {}
    for r in search.search_products(queries, shelf, X.Vocabulary()).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.product_id, r.final_score))
    assert found[1][0][0] == 2 and found[2][0][0] == 1
    assert found[1][0][1] > found[1][1][1]
    assert 4 not in found and 5 not in found


def test_jsonld(spark):
    script = lambda body: f'<html><script type="application/ld+json">{body}</script></html>'
    rows = [(1, script('{"@type":"Product","name":"A &amp; B","offers":{"price":"10","priceCurrency":"KES"}}')), (2, script('[{"@type":"Thing"},{"@type":"Product","name":"C","offers":[{"price":5}]}]')),
            (3, script("{broken")), (4, "<html></html>"), (5, script('{"@type":"Product","name":"D"}') + script('{"@type":"Product","name":"E"}'))]
    got = pages.extract_jsonld_items(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert sorted((r.page_id, r.name, r.price) for r in got) == [(1, "A & B", "10"), (2, "C", "5"), (5, "D", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_are_anchored(spark, seed):
    base = [0, 10, 31, 40, 62, 70] if seed == 1 else sorted(random.Random(seed).choices(range(400), k=60))
    df = spark.createDataFrame([(u, m * 60, i) for u in (1, 2) for i, m in enumerate(base)], "user_id int, s long, product_id int").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.session for r in graph.anchored_sessions(df).where("user_id = 1").orderBy("ts", "product_id").collect()]
    want, anchor, n = [], None, -1
    for m in base:
        if anchor is None or m - anchor > 30:
            anchor, n = m, n + 1
        want.append(n)
    assert got == want


def test_lead_lag_finds_a_planted_delay(spark):
    rng = random.Random(4)
    x = [rng.random() for _ in range(40)]
    rows = [("p", 1, i, x[i + 3]) for i in range(30)] + [("p", 2, i, x[i]) for i in range(30)] + [("p", 3, i, 1.0) for i in range(30)] + [("p", 4, i, 2.0) for i in range(9)]
    df = spark.createDataFrame(rows, "product string, store int, position long, price double").withColumn("t", F.timestamp_seconds("position"))
    found = {(r.store_a, r.store_b): (r.lag, r.lag_correlation) for r in mining.lead_lag(df, "product", "store").collect()}
    assert found == {(1, 2): (3, 1.0)}
    lead = mining.leader_followers(mining.lead_lag(df, "product", "store")).collect()
    assert [(r.leader, r.follower) for r in lead] == [(1, 2)]


def test_credibility(spark):
    now = "2024-01-31 00:00:00"
    rows = [(1, "verified", 365, 0), (2, "verified", 365, 0), (3, "rejected", 364, 91), (4, "pending", 730, 90), (5, None, 10, 0)]
    sellers = spark.createDataFrame(rows, "seller_id int, verification_status string, age int, idle int").withColumns(
        {"created_at": F.lit(now).cast("timestamp") - F.make_dt_interval("age"), "updated_at": F.lit(now).cast("timestamp") - F.make_dt_interval("idle")})
    reviews = spark.createDataFrame([(1, 5)] * 60 + [(3, 1)] + [(4, 4)] * 2, "seller_id int, rating int")
    got = {r.seller_id: r.credibility_score for r in trust.credibility_score(sellers, reviews, now).collect()}
    assert got[1] == 5.0 and got[2] == 3.0 and got[5] == 1.0
    assert got[3] == pytest.approx(0.4 + 0.02 + 0.2 * 364 / 365 * 5, abs=1e-6)
    assert got[4] == pytest.approx(1.6 + 0.04 + 0.2 * 5 * 0.95 + 0.1 + 0.1 * 2, abs=1e-6)


def test_bursts(spark):
    reviews = spark.createDataFrame([(1, 100 + i, 1) for i in range(4)] + [(1, i, 1) for i in range(2)] + [(9, i, 300) for i in range(2)] + [(2, 200 + i, 1) for i in range(3)], "seller_id int, reviewer_id int, ago int")
    reviews = reviews.withColumn("created_at", F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval("ago"))
    assert [r.seller_id for r in trust.review_bursts(reviews, "2024-01-31 00:00:00").collect()] == [1]


def test_forest_flags_an_outlier(spark):
    rows = [(i, 1, i, 1, 100.0 + i % 7) for i in range(400)] + [(999, 1, 999, 1, 90000.0), (1000, 1, 1000, 1, -1.0)]
    df = spark.createDataFrame(rows, "product_id long, store_id long, batch_id long, line_no int, price_kes double").withColumn("verified_at", F.lit("2024-01-30").cast("timestamp"))
    trees = anomaly.iforest_fit(df, "2024-01-31 00:00:00", trees=40, sample=128)
    got = {r.product_id: r for r in anomaly.iforest_score(df, trees, contamination=0.01, sample=128).collect()}
    assert got[999].is_anomaly and got[999].anomaly_score < min(got[i].anomaly_score for i in range(400)) and got[1000].anomaly_score is None and not got[1000].is_anomaly
    assert anomaly.iforest_fit(df.limit(10), "2024-01-31 00:00:00").count() == 0


def test_scans_and_versions(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"name":"Milk","category":"dairy","brand":null,"sizes_variants":["1l"]},{"name":" ","category":"x"}]')
    good, bad = tables.scan_products_json(spark, str(tmp_path / "p.json"))
    assert [r.name for r in good.collect()] == ["Milk"] and [r.reject_reason for r in bad.collect()] == ["name"]
    (tmp_path / "s.json").write_text('[{"chain_name":"N","branch_name":"B"},{"chain":"C","branch":"D"},{"town":"T"}]')
    assert {(r.chain, r.branch) for r in tables.scan_stores_json(spark, str(tmp_path / "s.json")).collect()} == {("N", "B"), ("C", "D")}
    (tmp_path / "syn.txt").write_text("# words\nMaziwa\tMilk\nunga, flour\nunga,maize flour\nbroken\n")
    assert {r.word: r.synonym for r in tables.scan_synonyms(spark, str(tmp_path / "syn.txt")).collect()} == {"maziwa": "milk", "unga": "maize flour"}
    tables.save_version(spark.range(3), str(tmp_path / "t"), 1)
    assert tables.load_version(spark, str(tmp_path / "t"), 1).count() == 3


def test_ingest_stream_matches_batch(spark, tmp_path):
    rows = [(i % 4, str(i % 3), "-5" if i == 7 else str(10 + i), "manual", f"2024-01-{1 + i % 5:02d} 10:00:00", "true", None, i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, streams.RAW_ITEMS)
    for k in range(2):
        df.where(f"batch_id % 2 = {k}").write.mode("append").json(str(tmp_path / "in"))
        streams.stream_ingest_prices(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "2024-02-01 00:00:00").awaitTermination(60)
    got = {(r.product_id, r.store_id, r.day): r.price_kes for r in streams.read_ingested(spark, str(tmp_path / "out")).collect()}
    want = {}
    for n, (p, s, price, _source, t, *_rest) in sorted((r[7], r) for r in rows if r[2] != "-5"):
        want[(p, s, t[:10])] = max(want.get((p, s, t[:10]), (-1, 0)), (n % 2, n, float(price)))
    assert {(p, s, str(d)): v for (p, s, d), v in got.items()} == {k: v[-1] for k, v in want.items()}
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 1


def test_embedding_stream(spark, tmp_path):
    products = spark.createDataFrame([(1, "Milk", "B"), (2, "Tea", None)], "product_id long, name string, brand string")
    make = lambda rows: spark.createDataFrame(rows, "product_id long, intent string, t string").select("product_id", "intent", F.col("t").cast("timestamp").alias("created_at"))
    for rows in ([(1, "create", "2024-01-01"), (2, "create", "2024-01-01"), (3, "create", "2024-01-01")], [(2, "update", "2024-01-02"), (2, "delete", "2024-01-03")]):
        make(rows).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_embed_upsert(streams.stream_outbox(spark, str(tmp_path / "in")), products, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r.product_id, r.text) for r in streams.read_vectors(spark, str(tmp_path / "out")).collect()) == [(1, "B"), (1, "Milk")]


def _soundex(word):
    codes = {c: d for d, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
    out, last = "", codes.get(word[0])
    for c in word[1:]:
        d = codes.get(c)
        if d and d != last:
            out += str(d)
        if c not in "hw":
            last = d
    return (word[0].upper() + out + "000")[:4]


def _metaphone(text):
    """By scanning, with what a letter takes along with it skipped."""
    s, out, i = text.lower(), "", 0
    for silent in ("kn", "gn", "pn", "wr", "ae"):
        if s.startswith(silent):
            s = s[1:]
            break
    while i < len(s):
        c, d, dd, b = s[i], s[i + 1 : i + 2], s[i + 2 : i + 3], s[i - 1 : i] if i else ""
        shun, skip, code = d == "i" and dd in ("o", "a"), 1, ""
        if c == d and c != "c":
            pass
        elif c in "aeiou":
            code = c.upper() if b in ("", " ") else ""
        elif c == "c":
            code, skip = ("X", 2) if d == "h" or d + dd == "ia" else ("S", 2) if d in ("i", "e", "y") else ("K", 1)
        elif c == "d":
            code, skip = ("J", 3) if d == "g" and dd in ("i", "e", "y") else ("T", 1)
        elif c == "g":
            code, skip = ("J", 1) if d in ("i", "e", "y") else ("", 2) if d == "h" and dd not in tuple("aeiou") else ("K", 1)
        elif c == "h":
            code = "H" if b == "" or d in tuple("aeiou") or b not in "aeiou" else ""
        elif c == "k":
            code = "" if b == "c" else "K"
        elif c == "p":
            code, skip = ("F", 2) if d == "h" else ("P", 1)
        elif c == "s":
            code, skip = ("X", 2) if d == "h" else ("X", 3) if shun else ("S", 1)
        elif c == "t":
            code, skip = ("X", 1) if shun else ("0", 2) if d == "h" else ("", 1) if d + dd == "ch" else ("T", 1)
        elif c == "w":
            code, skip = ("W", 2) if b == "" and d == "h" else ("W", 1) if d in tuple("aeiou") else ("", 1)
        elif c == "x":
            code = "KS" if b else "X" if d == "h" or shun else "S"
        elif c == "y":
            code = "Y" if d in tuple("aeiou") else ""
        elif c == " ":
            code = " " if out and out[-1] != " " else ""
        else:
            code = {"q": "K", "v": "F", "z": "S", **{x: x.upper() for x in "bfjlmnr"}}.get(c, "")
        out, i = out + code, i + skip
    return out.strip()


def test_metaphone(spark):
    rng = random.Random(12)
    known = {"Thompson": "TMSN", "knight": "NT", "phone": "FN", "cheese": "XS", "sugar": "SKR", "bridge": "BRJ", "nation": "NXN", "whale": "WL", "xylo": "SL", "wrap": "RP", "sachet": "SXT", "kericho gold": "KRX KLT"}
    words = [*known, *("".join(rng.choices("abcdeghhikmnopqstuvwxyzé 1", k=rng.randrange(1, 9))) for _ in range(3000))]
    got = column(spark, words, S.metaphone)
    assert got == [_metaphone(w) for w in words]
    assert {k: v for k, v in zip(words, got, strict=True) if k in known and k != "Thompson"} == {k: v for k, v in known.items() if k != "Thompson"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def _match(a, b):
    small, large = sorted((len(a), len(b)))
    if a == b:
        sim = 1.0
    elif a in b or b in a:
        sim = 0.7 + 0.3 * small / large
    else:
        sim = max(0.0, min(1.0, 1 - _distance(a, b) / large + 0.1 * (a[0] == b[0])) - 0.3 * (large - small) / large)
    sound = ((_soundex(a) == _soundex(b)) + (_metaphone(a) == _metaphone(b))) / 2 if a.isalpha() and b.isalpha() else 0.0
    return min(1.0, 0.7 * sim + 0.3 * sound + 0.1 * (a == b))


@pytest.mark.parametrize("threshold, few", [(0.3, 0), (0.6, 0), (0.6, 1 << 20)])
def test_fuzzy_match_loses_nothing(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(search, "FEW_PAIRS", few)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abnrst", k=rng.choice([1, 2, 3, 5, 8])))
    terms, asked = sorted({word() for _ in range(120)} | {"banana"}), ["an", "banan", *[word() for _ in range(25)]]
    found = search.fuzzy_cross_match(
        spark.createDataFrame([(i, f" {a.upper()} ") for i, a in enumerate(asked)], "query_id long, text string"),
        spark.createDataFrame([(i, w, "name") for i, w in enumerate(terms)], "product_id long, term string, term_type string"), threshold, block_rows=9)
    got = {(r.query_id, r.matched_term): r.score for r in found.collect()}
    want = {(i, w): s for i, a in enumerate(asked) for w in terms if round(s := _match(a, w), 3) >= threshold}
    near = {k for k, s in want.items() if abs(s - threshold) < 0.0006}
    assert got.keys() - near == want.keys() - near and all(abs(got[k] - want[k]) < 0.0006 for k in got.keys() & want.keys())
    assert threshold > 0.3 or (0, "banana") in got


def test_nearest_vectors_with_ties(spark):
    rng = random.Random(2)
    vectors = [(i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(vectors, "product_id long, embedding array<float>")
    got = {}
    for r in search.knn_join(df.where("product_id < 6").withColumnRenamed("product_id", "query_id"), df, 7, block_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    for i, v in vectors[:6]:
        order = sorted(vectors, key=lambda w: (-round(sum(a * b for a, b in zip(unit(v), unit(w[1]))), 6), w[0]))
        assert got[i] == [j for j, _ in order[:7]]


def test_saved_forest_scores_the_same(spark, sf):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    assert rows("model_io") == rows("iforest_score")


def test_maintenance(spark, sf):
    got = {r.part: (r.status, r.n > 0) for r in QUERIES["maintenance_job"](spark, sf).collect()}
    assert got == dict.fromkeys(("anomaly_trees", "similarities", "correlations", "credibility"), ("ok", True))
