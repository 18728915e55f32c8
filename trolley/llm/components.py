"""Connected components: spanning forests of portions of the edges, then alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import released, stored

#: Edges that one task joins by itself.
PORTION = 200_000


def _pair(u: Column, v: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"))


def _star(edges: DataFrame, small: bool, parts: int) -> DataFrame:
    """Edges (u > v): every u's neighbours are linked to the least of u and them.

    Large star moves the neighbours above u; small star moves u and the neighbours below it. The result is written, so
    that the plan of a step never holds the steps before it.
    """
    u, v = F.col("u"), F.col("v")
    if not small:
        edges = edges.select(F.explode(F.array(_pair(u, v), _pair(v, u))).alias("e")).select("e.u", "e.v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").withColumn("m", F.least("m", "u"))
    if small:
        moved = moved.select(F.explode(F.array(_pair(v, F.col("m")), _pair(u, F.col("m")))).alias("e")).select("e.u", "e.v")
    else:
        moved = moved.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    return stored(moved.where(F.col("u") != F.col("v")).distinct().coalesce(parts), "edges")


def _plain(node: object) -> object:
    return tuple(node.values()) if isinstance(node, dict) else node


def forests(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Edges with the same components: those of each task's portion as stars around their least nodes, with these as edges to themselves if wanted."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        whole: dict = {}

        def root(x: object) -> object:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def start(x: object) -> object:
            parent.setdefault(x, x)
            return root(x)

        kind = None
        for batch in batches:
            kind = batch.column("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = _plain(u), _plain(v)
                whole[a], whole[b] = u, v
                a, b = sorted((start(a), start(b)))
                parent[b] = a
        if kind is not None:
            moved = [(x, root(x)) for x in parent if roots or root(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([whole[x[k]] for x in moved], kind) for k in (0, 1)], names=["u", "v"])

    return edges.mapInArrow(joined, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (u, v); self-links are ignored.

    Nodes are of one ordered type: numbers, strings, or structs of those that compare field by field.
    """
    edges = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    parts = 1 + edges.count() // PORTION
    if parts == 1:  # the forest of a single portion is the answer
        found = stored(forests(edges.coalesce(1), roots=True).toDF("node", "component"), "components")
        released(edges)
        return found
    fewer = stored(forests(edges.coalesce(parts)), "edges")
    released(edges)
    edges, state = fewer, None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        large = _star(edges, False, parts)
        small = _star(large, True, parts)
        released(edges, large)
        edges = small
    roots = F.explode(F.array(_pair(F.col("u"), F.col("v")), _pair(F.col("v"), F.col("v"))))
    found = stored(edges.select(roots.alias("e")).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct(), "components")
    released(edges)
    return found
