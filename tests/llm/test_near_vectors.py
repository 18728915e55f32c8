import math

import numpy as np
import pytest

from trolley.llm import near_vectors as V


def brute(rows, t=0.95):
    d = max([len(v) for _, v in rows if v] or [1])
    good = []
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v + [0.0] * (d - len(v)), dtype=np.float64)
            u /= np.abs(u).max()
            good.append((i, u / np.linalg.norm(u)))
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    if good:
        u = np.stack([x for _, x in good])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= t, 1)), strict=True):
            i, j = good[a][0], good[b][0]
            links[i] += 1
            links[j] += 1
            root[top(i)] = top(j)
    names = {}
    for i, (vec_id, _) in enumerate(rows):
        names.setdefault(top(i), []).append(vec_id)
    named = [min([x for x in names[top(i)] if x is not None], default=None) for i in range(len(rows))]
    return sorted(((v, links[i], named[i], v == named[i]) for i, (v, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, **options).collect()), key=str)


def planted(seed, n, d, spread):
    """Clusters of several widths, copies, chains."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    out = []
    for i in range(n):
        kind = i % 5
        c = centres[rng.integers(6)]
        v = rng.normal(size=d) if kind == 0 else c if kind == 1 else c + spread * rng.normal(size=d)
        out.append([float(np.float32(x)) for x in v])
    return out


@pytest.mark.parametrize("kind, d, spread", [("float", 20, 0.25), ("double", 5, 0.3), ("float", 40, 0.02)])
def test_against_brute_force(spark, kind, d, spread):
    vectors = planted(d, 1500, d, spread)
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), vectors[1], vectors[1][: d - 2], [x * 3 for x in vectors[2]], [-0.0] * d]
    rows = [(1000 + i, v) for i, v in enumerate(vectors)] + [(i, v) for i, v in enumerate(odd)] + [(None, vectors[3]), (None, [1.0, -9.0] * 2), (1001, vectors[0]), (5, vectors[6]), (5, vectors[6])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, component_id string").repartition(4)
    got, want = found(df, tile_rows=256), brute(rows)
    assert got == want and sum(w[1] > 0 for w in want) > 100


def test_one_group_holds_all(spark):
    rng = np.random.default_rng(1)
    vectors = [[1.0, 2.0, 3.0]] * 900 + [[float(np.float32(x)) for x in np.array([1, 2, 3]) + 0.01 * rng.normal(size=3)] for _ in range(700)]
    rows = list(enumerate(vectors))
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile_rows=256) == sorted([(i, 1599, 0, i == 0) for i in range(1600)], key=str)


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert found(df) == [(1, 0, 1, True), (2, 0, 2, True)] and found(df.limit(0)) == []


def test_bounds_stop_pairs_but_lose_none():
    rng = np.random.default_rng(5)
    x = V.unit_rows(rng.normal(size=(700, 96)))
    y = V.unit_rows(np.concatenate([x[:50] + 0.02 * rng.normal(size=(50, 96)), rng.normal(size=(300, 96))]))
    basis = np.linalg.qr(rng.normal(size=(96, 96)))[0]
    copies = rng.integers(1, 4, 1050)
    links = V.compare(x, y, basis, 0.9, copies)
    m = x @ y.T >= 0.9
    assert np.array_equal(links.degree, np.concatenate([m @ copies[700:], copies[:700] @ m])) and m.sum() >= 50
    assert all(links.root[i] == links.root[700 + j] for i, j in zip(*np.nonzero(m), strict=True))


def test_far_tiles_are_not_compared(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.02 * rng.normal(size=12)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id as node", "1L as copies", "embedding")
    tiles = V.tiled(df, V.principal_components(df, 12), 4000, 256)
    tiles = tiles.withColumn("tile", V.F.xxhash64(*V.TILE)).cache()
    n = tiles.select("tile").distinct().count()
    assert V.near_tiles(tiles, 0.95).count() < 0.6 * n * (n + 1) / 2
