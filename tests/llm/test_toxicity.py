import zlib

import numpy as np

from trolley.llm import toxicity as X


def test_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    scored = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    truth = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = np.mean([(scored[d] >= 0.5) == bool(y) for d, y in truth])
    caught = np.mean([scored[d] >= 0.5 for d, y in truth if y])
    wrong = np.mean([scored[d] >= 0.5 for d, y in truth if not y])
    assert len(scored) == docs.count() and good > 0.95 and caught > 0.75 and wrong < 0.03


def test_held_out_labels_are_never_read(spark):
    rows = [(i, ("bad " if i % 3 == 0 else "fine ") * 5, int(i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(d, t, "en") for d, t, _ in rows], "doc_id long, text string, lang string")
    flip = lambda wrong: spark.createDataFrame([(d, 1 - y if wrong and zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in rows], "doc_id long, toxic int")
    a, b = (X.train(docs, flip(w), 50) for w in (False, True))
    assert np.array_equal(a.embedding, b.embedding) and a.offset == b.offset
    got = {r.doc_id: r.score for r in X.score(docs, a).collect()}
    assert all((got[d] >= 0.5) == bool(y) for d, _, y in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 60_000), (None, "x"), (3, "b"), (4, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert [r.score for r in X.score(docs, model).collect()] == [0.5] * 6
    assert X.drop_toxic(docs, labels).count() == 6
    assert X.score(docs.limit(0), model).count() == 0


def test_pooling_takes_no_words_of_neighbours():
    rng = np.random.default_rng(1)
    model = X.Classifier(rng.normal(size=(2 * X.BUCKETS, X.DIM)).astype(np.float32), {w: rng.normal(size=(w, X.DIM, X.FILTERS)).astype(np.float32) for w in X.WIDTHS},
                         {w: np.zeros(X.FILTERS, np.float32) for w in X.WIDTHS}, rng.normal(size=X.FILTERS * 3).astype(np.float32), 0.1)
    docs = [X.word_ids(t) for t in (b"one two three", b"", b"four", b"five six", b"")]
    together = model.score(docs)
    assert np.allclose(together, [model.score([d])[0] for d in docs], atol=1e-6) and together[1] == together[4]


def test_few_labels_in_many_languages(spark, sf):
    """No language has labels enough for a threshold of its own; toxic documents go all the same."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*rng.choice(words, 8), "vile" if i % 5 == 0 else "kind", *rng.choice(words, 8)]), "abcde"[i // 5 % 5], int(i % 5 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows if d < 100], "doc_id long, toxic int")
    assert X.train(docs, labels).thresholds == {}
    assert {r.doc_id for r in X.drop_toxic(docs, labels).collect()} == {d for d, _, _, y in rows if not y}

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = {r.doc_id for r in X.drop_toxic(docs, labels).select("doc_id").collect()}
    learnt = [(r.doc_id in left, r.toxic) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert not any(stays for stays, y in learnt if y) and all(stays for stays, y in learnt if not y)


def test_thresholds_come_from_labels_that_the_model_has_not_seen(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(12)], 6)) + (" vile" if i % 2 and rng.random() < 0.6 else ""), i % 2) for i in range(900)]
    docs = spark.createDataFrame([(d, t, "en") for d, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    fitted, real = [], X.fit
    monkeypatch.setattr(X, "fit", lambda docs, y, **k: fitted.append(len(y)) or real(docs, y, **k))
    folds = [zlib.crc32(str(d).encode()) % 5 for d, _, _ in rows]
    model = X.train(docs, labels, calibrate=True)
    assert fitted == [sum(f > 0 for f in folds), sum(f in (1, 3) for f in folds), sum(f in (2, 4) for f in folds)]
    assert model.thresholds.keys() == {"en"} and 0.5 <= model.thresholds["en"] <= 0.95
    scores = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert {r.doc_id for r in X.drop_toxic(docs, labels).collect()} == {d for d, s in scores.items() if s < model.thresholds["en"]}


def test_thresholds_by_language():
    """A planted language whose clean texts score high gets a higher threshold; few labels stay near that of all."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 3000)
    langs = rng.choice(["en", "xx"], 3000).tolist()
    scores = np.where(y == 1, rng.uniform(0.85, 1, 3000), rng.uniform(0, [0.45 if x == "en" else 0.78 for x in langs]))
    few = [(0.9, 1, "zz"), (0.2, 0, "zz"), (0.3, 0, "none of it")]
    scores, y, langs = np.append(scores, [f[0] for f in few]), np.append(y, [f[1] for f in few]), langs + [f[2] for f in few]
    found, pooled = X.calibrated(scores, y, langs)
    assert found.keys() == set(langs) and 0.5 <= found["en"] < 0.52 and found["xx"] > 0.72
    assert found["none of it"] == pooled and abs(found["zz"] - pooled) < 0.05
    assert X.calibrated(scores[:0], y[:0], []) == ({}, 0.5)


def test_every_language_has_a_threshold(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels, calibrate=True)
    learnt = docs.join(labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0"), "doc_id").select("lang").distinct()
    assert model.thresholds.keys() == {r.lang for r in learnt.collect()} and all(0.5 <= t <= 0.95 for t in model.thresholds.values())


def test_gradients_of_a_batch_are_those_of_its_documents():
    rng = np.random.default_rng(2)
    some = lambda *shape: 0.3 * rng.normal(size=shape)
    model = X.Classifier(some(2 * X.BUCKETS, X.DIM), {w: some(w, X.DIM, X.FILTERS) for w in X.WIDTHS}, {w: some(X.FILTERS) for w in X.WIDTHS}, some(X.FILTERS * 3), 0.1)
    docs, y = [X.word_ids(t) for t in (b"one two three two", b"", b"four", b"five six seven")], np.array([1.0, 0, 0, 1])
    loss = lambda m: -np.log([s if t else 1 - s for s, t in zip(m.score(docs), y, strict=True)]).mean()
    grads, rows, values = [np.zeros_like(p) for p in (*model.filters.values(), *model.bias.values(), model.output)], [], []
    offset = X._gradients(model, docs, y, 4, grads, rows, values)
    bucket = int(docs[0][1, 0])
    dense = sum(v[r == bucket].sum(axis=0) for r, v in zip(rows, values, strict=True))

    def numeric(array, at):
        old, out = array[at], []
        for step in (1e-4, -1e-4):
            array[at] = old + step
            out.append(loss(model))
        array[at] = old
        return (out[0] - out[1]) / 2e-4

    assert abs(numeric(model.filters[2], (1, 3, 4)) - grads[1][1, 3, 4]) < 1e-3
    assert abs(numeric(model.bias[3], 5) - grads[5][5]) < 1e-3 and abs(numeric(model.output, 7) - grads[6][7]) < 1e-3
    assert abs(numeric(model.embedding, (bucket, 2)) - dense[2]) < 1e-3
    model.offset += 1e-4
    up = loss(model)
    model.offset -= 2e-4
    assert abs((up - loss(model)) / 2e-4 - offset) < 1e-3
