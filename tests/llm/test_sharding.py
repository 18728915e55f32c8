import random
import struct
import zlib
from collections import Counter

import xxhash

from trolley.llm import sharding as S


def shards_of(spark, rows, shards):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, shard int").repartition(3)
    return S.assign_shards(docs, shards=shards).collect()


def check(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_counts_and_slots(spark):
    rows = [(i, f"té{i % 7}" * (i % 5)) for i in range(997)] + [(None, None), (None, "x"), (5, "again"), (5, "again")]
    check(rows, shards_of(spark, rows, 40), 40)
    check(rows[:3], shards_of(spark, rows[:3], 40), 40)
    assert shards_of(spark, [], 4) == []


def test_one_key_repeated(spark):
    rows = [(1, "same")] * 600 + [(i, "t") for i in range(300)]
    check(rows, shards_of(spark, rows, 7), 7)


def test_little_moves(spark):
    """A new shard takes about its share; few other rows move."""
    rows = [(i, "t") for i in range(4000)]
    a = {r.doc_id: r.shard for r in shards_of(spark, rows, 10)}
    b = {r.doc_id: r.shard for r in shards_of(spark, rows, 11)}
    moved = sum(a[d] != b[d] for d in a)
    assert moved < 0.2 * len(rows)


def test_plan_fills_every_shard():
    _, owner = S.ring(5, 8)
    counts = {3: 1000, 17: 1, 30: 2}
    plan = S.plan_arcs(counts, owner, 5)
    ends = sorted((arc, first) for arc, first, _, _ in plan)
    assert {arc for arc, _ in ends} == set(counts)
    assert len({(shard, slot) for _, _, shard, slot in plan}) == len(plan)


def test_walk_row_by_row(spark):
    """Every row goes clockwise from its place on the ring to the first shard with room, in turns: walked here one row at a time."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, i, i, i, i]), "x" * rng.randrange(5)) for i in range(900)]
    shards, nodes = 9, 64
    points = sorted((xxhash.xxh3_64_intdigest(f"shard-{s}-node-{v}") - (1 << 63), s) for s in range(shards) for v in range(nodes))
    key = xxhash.xxh64_intdigest(b"key", seed=42)
    arcs = {}
    for doc_id, text in rows:
        h = key if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=key)
        h -= (h >> 63) << 64
        arc = next((i for i, (p, _) in enumerate(points) if p >= h), 0)
        arcs.setdefault(arc, []).append((h, doc_id is not None, doc_id or 0, len(text) + 16, zlib.crc32(text.encode()), doc_id))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    held, want = [0] * shards, []
    queues = {a: sorted(r)[::-1] for a, r in sorted(arcs.items())}
    for turn in range(len(points)):
        for arc, left in queues.items():
            shard = points[(arc + turn) % len(points)][1]
            while left and held[shard] < room[shard]:
                *_, size, crc, doc_id = left.pop()
                want.append((doc_id, size, crc, shard, held[shard]))
                held[shard] += 1
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards_of(spark, rows, shards)]
    assert sorted(got, key=str) == sorted(want, key=str)
