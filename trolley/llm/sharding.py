"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual_nodes` points on a ring of 64-bit hashes; a key belongs to the arc that ends at the
next point clockwise. A shard holds at most its share (rows: floor or ceiling of the mean), and
keys that find it full continue clockwise to the next shard with room. Which keys of an arc are taken first is
settled by their hash and id, so the result depends on the rows alone.

The walk is planned on the counts of arcs (at most shards x virtual_nodes of them, whatever the data);
rows are then placed by arc and rank within the arc.

A null text has size 16 and CRC-32 0 (as the empty text); null ids share one place on the ring. Rows that repeat an id are rows of their own.
Arcs are ranked in slices of the hash, so a key that repeats without end is the only thing that one task must sort.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import ranked, stored, text_or_empty


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points (signed 64-bit) and the shard of each."""
    points = sorted((xxhash.xxh3_64_intdigest(f"shard-{s}-node-{v}") - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def plan_arcs(counts: dict[int, int], owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot) of each stretch of an arc's ranks.

    Arcs are walked in turns: in turn t each arc offers what is left of it to the shard of the t-th point
    clockwise, arcs in ring order, until all is placed; a full shard passes everything on.
    """
    total, n = sum(counts.values()), len(owner)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    left = dict(sorted(counts.items()))
    at = dict.fromkeys(left, 0)
    out = []
    for turn in range(n):
        for arc in list(left):
            shard = int(owner[(arc + turn) % n])
            take = min(left[arc], room[shard] - used[shard])
            if take:
                out.append((arc, at[arc], shard, used[shard]))
                used[shard] += take
                at[arc] += take
                left[arc] -= take
                if not left[arc]:
                    del left[arc]
        if not left:
            break
    return out


def arc_of(key: Column, points: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(np.searchsorted(points, h.to_numpy(), side="left") % len(points)).astype("int32")

    return find(key)


def assign_shards(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs, counts of shards at most one apart."""
    points, owner = ring(shards, virtual_nodes)
    t = text_or_empty()
    keys = docs.select(
        "doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), "doc_id").alias("h"))
    keys = stored(keys.withColumn("arc", arc_of(F.col("h"), points)), "shard-keys")
    counts = keys.groupBy("arc").count().collect()  # at most shards x virtual_nodes rows
    largest = max((r["count"] for r in counts), default=0)
    plan = plan_arcs({r["arc"]: r["count"] for r in counts}, owner, shards)

    ranks = ranked(keys, "arc", ["h", "doc_id", "size", "text_crc32"], largest)

    arc, first, shard, slot = (np.array(c, dtype=np.int64) for c in zip(*sorted(plan), strict=True)) if plan else [np.zeros(1, dtype=np.int64)] * 4
    stretch = (arc << 48) + first  # as arcs and ranks are far below 2 ** 15 and 2 ** 48, these sort like pairs

    @F.pandas_udf("shard int, slot long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for arcs, ranks in batches:
            rank = ranks.to_numpy()
            i = np.searchsorted(stretch, (arcs.to_numpy().astype(np.int64) << 48) + rank, side="right") - 1
            yield pd.DataFrame({"shard": shard[i].astype(np.int32), "slot": slot[i] + rank - first[i]})

    placed = ranks.withColumn("at", place("arc", "rank"))
    return placed.select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))
