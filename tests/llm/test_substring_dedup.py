import random

import pytest

from trolley.llm import substring_dedup as S


def pieces(text, unit):
    """(normalised text, start, end, words) of the lines of a text, or of their sentences: character by character."""
    out, start = [], 0
    marks = ".!?" if unit == "sentence" else ""

    def close(end):
        nonlocal start
        raw = text[start:end]
        words = raw.lower().split()
        lone = all(c in marks for c in raw)  # marks without anything before them
        if words and not lone:
            out.append((" ".join(words), end - len(raw.lstrip()), end, len(words)))
        start = end

    for i, c in enumerate(text):
        if c == "\n":
            close(i)
            start = i + 1
        elif marks and c not in marks and i > start and text[i - 1] in marks:
            close(i)
    close(len(text))
    return out


def brute(rows, least, unit):
    """Runs to remove by going through all units in rank order, with the place of the kept occurrence of each first unit."""
    seen, out = {}, []

    def close(doc_id, run, name):
        if run and sum(u[3] for u in run) >= least:
            out.append((doc_id, run[0][1], run[-1][2], len(run), sum(u[3] for u in run), *seen[run[0][0]], name))

    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        text, names = text or "", ["sentence"] if unit == "sentence" else ["line"]
        units = [(u, 0) for u in pieces(text, "sentence" if unit == "sentence" else "line")]
        if unit == "passage":
            names = ["line", "sentence"]
            for line, _ in list(units):
                at = text.rfind("\n", 0, line[1]) + 1
                inside = [(t, a + at, z + at, w) for t, a, z, w in pieces(text[at : line[2]], "sentence")]
                units += [(u, 1) for u in inside] if len(inside) > 1 else []
        again = set()
        for u, level in sorted(units, key=lambda x: (x[0][1], x[1])):
            again |= {(u, level)} if u[0] in seen else set()
            seen.setdefault(u[0], (doc_id, u[1]))
        lines = [u for u, level in units if level == 0]
        for level, name in enumerate(names):
            run, of = [], None
            for u in (u for u, k in units if k == level):
                own = next(x for x in lines if x[1] <= u[1] and u[2] <= x[2])
                gone = (u, level) in again and not (level and (own, 0) in again)
                if run and (not gone or level and own != of):
                    close(doc_id, run, name)
                    run = []
                run, of = run + [u] if gone else [], own
            close(doc_id, run, name)
    return sorted(out, key=str)


def got(spark, rows, least, unit, parts=3):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(parts)
    runs = S.repeated_runs(docs, least, unit)
    return sorted([(r.doc_id, r.start, r.end, r.units, r.words, r.keep_doc_id, r.keep_start, r.unit) for r in runs.collect()], key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    sentences = [" ".join(rng.choices(["ä", "bb", "Ccc", "𝄞d", "e"], k=rng.randrange(1, 14))) + rng.choice(".!?") for _ in range(60)]
    rows = [(i, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "  \n\n"]) for _ in range(rng.randrange(30)))) for i in range(80)]
    rows += [(None, sentences[0] * 4), (500, None), (501, ""), (502, "..!\n\n"), rows[7]]
    for least, unit, parts in ((1, "sentence", 1), (12, "sentence", 7), (20, "sentence", 3), (1, "line", 7), (1, "passage", 4), (9, "passage", 2)):
        assert got(spark, rows, least, unit, parts) == brute(rows, least, unit)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for least in (1, 20):
        assert got(spark, rows, least, "sentence") == brute(rows, least, "sentence")
        assert got(spark, rows, least, "passage") == brute(rows, least, "passage")
    assert got(spark, rows, 1, "line") == brute(rows, 1, "line")


def test_removal_keeps_the_first(spark):
    passage = "This passage goes on for quite some time. It has two sentences of which both are long enough, or so one hopes."
    rows = [(2, f"New. {passage} End."), (1, f"é {passage.upper()}"), (3, passage)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, removed_by string")
    out = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in S.remove_repeats(docs, least_words=10, unit="sentence").collect()}
    # document 1 holds the first sentence with "é" before it, so that document 2 has it first; nothing of document 3 is new
    assert out[3][0].strip() == ""
    assert out[1] == ("é " + passage.upper(), [])
    assert passage.split(". ")[1] not in out[2][0] and out[2][0].startswith("New.") and out[2][0].endswith(" End.")
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_short_repeats_go_too(spark, tmp_path):
    """A line of a few words between others that don't repeat is found wherever it comes again."""
    from trolley.llm.queries import QUERIES

    rows = [(i, f"Only document {i} says this\nall rights are reserved\nand this is said by {i} alone") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    line = rows[0][1].split("\n")[1]
    want = [(i, t.index(line), t.index(line) + len(line), 1, 4) for i, t in rows[1:]]
    found = QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert sorted(found) == sorted(S.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(tuple(r)[:5] for r in found) == want and {(r.keep_doc_id, r.keep_start) for r in found} == {(0, want[0][1])}
    assert {r.doc_id: r.text for r in QUERIES["line_dedup"](spark, str(tmp_path)).collect()} == {i: t if i == 0 else t.replace(line, "") for i, t in rows}
    left = {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {i: t if i == 0 else t.replace(line, "") for i, t in rows}
    assert {r.doc_id: r.text for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least_words=20).collect()} == dict(rows)


def test_passages_inside_lines(spark):
    """A passage that is a line of its own in one text and inside a line of another is found; clean texts lose nothing."""
    passage = "Here is a passage of some length that comes twice. It has a second sentence as well! And a third"
    rows = [(1, f"Before it.\n{passage}\nAfter it"), (2, f"Something else. {passage}. And more"), (3, f"New here\n{passage}\nnew there"), (4, "Nothing of this repeats. Not at all.\nReally nothing")]
    want = [(2, 16, 16 + len(passage.rsplit("!", 1)[0]) + 1, 2, 17, 1, 11, "sentence"), (3, 9, 9 + len(passage), 1, 20, 1, 11, "line")]
    assert got(spark, rows, 1, "passage") == want == brute(rows, 1, "passage")


def test_rows_that_share_an_id(spark):
    """What goes from one text doesn't go from another one with its id; columns of any name stay, `removed` is the operator's."""
    rows = [(5, "Alpha beta gamma", 1), (5, "Passage here\nAlpha", 2), (1, "Passage here", 3), (None, "Passage here", 4), (None, "Other", 5), (9, "x\n" * 3000, 6), (9, "x\n" * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, run_id int").selectExpr("*", "'mine' as removed", "1 as hash")
    out = S.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "run_id", "hash", "removed"]
    assert sorted((r.run_id, r.text.strip()) for r in out.collect()) == [(1, "Alpha beta gamma"), (2, "Alpha"), (3, ""), (4, "Passage here"), (5, "Other"), (6, "x"), (6, "x")]
    with pytest.raises(TypeError):
        S.repeated_runs(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_a_unit_that_is_everywhere(spark, monkeypatch):
    rows = [(i, f"common line\nown line {i}") for i in range(3000)]
    assert got(spark, rows, 1, "line") == brute(rows, 1, "line")
