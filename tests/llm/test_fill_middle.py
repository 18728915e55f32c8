import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trolley.llm import fill_middle as M


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


TEXTS = [None, "", "a", "plain words, more words.\n\ttabs", "é𝄞 ünï — 漢字 x" * 9, "has <P> mark", "<S", "P><S", "<M <P", "\x00\x1f 12", "word" * 50_000, "é" * 40_000 + "tail", "<" * 30 + ">" * 30]


def test_against_brute_force(spark, monkeypatch):
    rows = [(k * 100 + i, t) for k in range(30) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, None), (7, "twice é"), (7, "twice é")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    made = M.fill_in_middle(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((d, *brute(d, t)) for d, t in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = {(r.doc_id, r.t) for r in made.select("doc_id", M.restored(made.output, made.form).alias("t")).collect()}
    assert back == {(d, t or "") for d, t in rows}
    assert M.digests(M.fill_in_middle(docs.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM é漢𝄞\n.", max_size=60), st.integers(1, 9), st.integers(0, 2**31))
def test_cuts_whatever_the_blocks(text, block, seed):
    old, M.BLOCK = M.BLOCK, block
    try:
        n, form, p, m, out = M.transform(text.encode(), (seed, seed * 7 + 3, 0, 50), 90, 20)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((seed % (n + 1), (seed * 7 + 3) % (n + 1)))
        assert n == len(units)
        if form != "plain":
            assert (p, m) == (len("".join(units[:a])), len("".join(units[a:b])))
            assert out.decode() == "<P>" + "".join(units[:a]) + "<S>" + "".join(units[b:]) + "<M>" + "".join(units[a:b])
        index = M.Exceptions.of(np.frombuffer(text.encode(), np.uint8))
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.code_points(at) == k and index.bytes(k) == at
    finally:
        M.BLOCK = old


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: sha(r.text or "") for r in docs.select("doc_id", "text").collect()}
    for r in M.digests(M.fill_in_middle(docs)).collect():
        w = want[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*w[:4], sha(w[4]), texts[r.doc_id])
