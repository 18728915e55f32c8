import hashlib
import re
import time

from trolley.llm import secret_scan as S

KEY = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5hJ7k"
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    base = [(m.start(), 1, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 2, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 3, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [(m.start(), 4, "bare", m.end()) for m in re.finditer(r"[A-Za-z0-9+/]{40,}", text)
            if len(m[0]) == 40 and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak += [(m.start(), 5, "endpoint", m.end()) for m in re.finditer(S.ENDPOINT, text)]
    near = lambda w: any(abs(x[0] - w[0]) <= S.REACH and x[2] in S.PARTNERS[w[2]] for x in base + weak)
    spans = sorted(base + [w for w in weak if near(w)])
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in xs)
    n = lambda k: sum(x[2] == k for x in base)
    return n("assign"), n("access"), n("hex"), hashlib.sha256(say(sorted(base)).encode()).hexdigest(), say(spans)


def test_against_brute_force(spark):
    texts = [
        None, "", "no secrets here", 'Password = "hunter2secret" token: abc', "secret=token: abcdef1", "api_key:'é' apikey=ABCDEF",
        "AKIA" + "B" * 16 + " and " + KEY, KEY, "x " * 500 + KEY + " y " * 500 + "AKIA" + "C" * 20,
        "é𝄞 " + "0123456789abcdef" * 3 + " https://example.org/x " + KEY, "10.0.0.1 then token = zzzzzzzz", "10.0.0.1 alone",
        ("AKIA" + "D" * 17 + " " + KEY + " ") * 40, "tOkEn==abc12 toſen=abcdefgh Key",
        KEY + " " * 359 + "AKIA" + "E" * 16, KEY + " " * 360 + "AKIA" + "E" * 16, KEY + " " * 361 + "AKIA" + "E" * 16,
    ]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in S.digests(S.scan_secrets(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i if i != 3 else None]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute(t), (i, t)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    for r in S.digests(S.scan_secrets(docs)).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == want[r.doc_id]


def test_links_name_the_nearest_partner(spark):
    text = "AKIA" + "B" * 16 + " " * 30 + KEY + " " * 100 + "AKIA" + "C" * 16 + " token=abcdefg https://example.org/" + " " * 2000 + "10.0.0.1"
    got = S.digests(S.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    bare, second = text.index(KEY), text.index("AKIAC")
    assert got.links == f"bare:{bare}>access:0,endpoint:{text.index('https')}>assign:{text.index('token')}" and second > bare


def test_many_parts_and_long_values(spark):
    """Work grows with the parts of a text, not with their square; every kind occurs thousands of times."""
    hexes = " ".join(f"{i:024x}" for i in range(20_000)) + " é " * 300_000
    mixed = " ".join(f"token={i:08d} AKIA{i:016d} {KEY} https://h{i}.example.org" for i in range(4000))
    docs = spark.createDataFrame([(1, hexes), (2, mixed), (3, "secret=" + "a1" * 750_000)], "doc_id long, text string").repartition(3)
    began = time.monotonic()
    got = {r.doc_id: r for r in S.digests(S.scan_secrets(docs)).collect()}
    assert time.monotonic() - began < 60
    assert (got[1].n_hex, got[2].n_assign, got[2].n_access, got[3].n_assign) == (20_000, 4000, 4000, 1)
    assert got[2].spans.count("bare:") == got[2].spans.count("endpoint:") == 4000
    assert (got[3].base_sha256, got[1].base_sha256) == (brute("secret=" + "a1" * 750_000)[3], brute(hexes)[3])


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan_secrets(docs).count() == 0
    twice = spark.createDataFrame([(1, "token=abcdefg")] * 2, "doc_id long, text string")
    assert [r.n_assign for r in S.digests(S.scan_secrets(twice)).collect()] == [1, 1]
