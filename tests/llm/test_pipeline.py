import os
import random

import corpus_pipeline
from trolley.llm import common


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == ids
    folder = f"{common.shared_dir(spark)}/trolley"
    there = set(os.listdir(folder))
    whole = corpus_pipeline.run(spark, sf)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - there}
    assert left == {"pipeline-decontaminate", *(x for x in left if x.startswith("pack"))}, left
    assert {r.doc_id for r in whole.collect()} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontaminate", "packing"]


def test_stages_against_brute_force(spark, tmp_path):
    """Null texts, repeated ids, columns of clashing names; what each stage leaves of its input, by plain Python."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    bases = [[word() for _ in range(rng.choice([8, 30, 120]))] for _ in range(30)]
    rows = []
    for base in bases:
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    item = " ".join(word() for _ in range(12))
    rows += [(900, f"{' '.join(word() for _ in range(60))} {item} {word()}"), (901, None), (901, ""), (902, rows[0][1] + " "), (902, "text of its own with the same id"), (None, "no id here"), (None, rows[3][1])]
    docs = spark.createDataFrame([(d, t, "en", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, row long").withColumnsRenamed({"row": "stays"})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: {r.stays for r in df.select("stays").collect()}
    stages = dict(corpus_pipeline.STAGES)
    left = stages["toxicity"](spark, docs, str(tmp_path))
    assert ids(left) == set(range(len(rows)))  # no labels

    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), d is not None, d or 0, i))
    exact = stages["exact_dedup"](spark, left, str(tmp_path)).cache()
    kept = ids(exact)
    assert exact.columns == docs.columns and len(kept) == len(groups)
    assert all(any(i in kept and (n, s, d) == min(g)[:3] for n, s, d, i in g) for g in groups.values())

    now = {i: rows[i] for i in sorted(kept)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, (_, t) in now.items()}
    root = {i: i for i in now}
    for a in now:
        for b in now:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    best = {}
    for i, r in root.items():
        best.setdefault(r, []).append((now[i][0] is None, now[i][0] or 0, i))
    near = stages["ngram_join"](spark, exact, str(tmp_path)).cache()
    assert near.columns == docs.columns and ids(near) == {min(g)[2] for g in best.values()}

    clean = stages["decontaminate"](spark, near, str(tmp_path))
    assert ids(clean) == {i for i in ids(near) if item not in (rows[i][1] or "")}
    packed = stages["packing"](spark, clean, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(rows[i][0]) for i in ids(clean))


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
