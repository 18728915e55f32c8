"""Near-duplicate vectors by tiles that are compared along their principal components.

Unit vectors are turned into the order of their principal components (all vectors' second moments, summed by Spark), so that the leading
coordinates hold most of their length. Slabs along the first component are cut along the second one into tiles, which are written as
blobs. Two tiles are compared only if the boxes around their leading coordinates are near enough. A comparison multiplies the
leading coordinates, adds the product of the norms of what is left (an upper bound by Cauchy-Schwarz) and drops all pairs that cannot
reach the threshold; the next components are added for the rest, and what remains is settled by the cosine of the vectors as they came, in
double precision. Pruning has slack, so no link is lost: it is exact.

Equal vectors are one, with a number of copies, and a comparison returns a count of links for each vector and a spanning forest of the links instead
of pairs. Nothing grows with the square of a group but the numbers compared inside a task.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Shorter vectors count as padded with zeros. Rows are
apart even if they repeat: each counts as a vector, also under one id or none; a component is named by the smallest id in it (null
if none has any). kept is null-safe: vec_id equals component_id. An empty table gives no rows. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import released, stored
from trolley.llm.components import components

THRESHOLD = 0.95
TILE_ROWS, TILE_VALUES = 2048, 1 << 17
#: Coordinates of a tile's box.
BOX = 8
SLACK = 1e-4
#: Equal vectors with a share of over 1 / HOT_VECTORS of the rows are looked up by broadcast, HOT_VECTORS rows at most.
HOT_VECTORS = 10_000
SUMS = 32


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_components(vectors: DataFrame, dimension: int) -> np.ndarray:
    """Columns are the eigenvectors of the second moments of all unit vectors, largest first."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros((dimension, dimension)), 0
        for batch in batches:
            u = unit_rows(_matrix(batch.column("embedding")))
            total += u.T @ u
            slot = int(batch.column("node")[0].as_py() >> 33) % SUMS  # by partition
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "moment"])

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"moment": pa.array([sum(np.frombuffer(x, np.float64) for x in group.column("moment").to_pylist()).tobytes()], pa.binary())})

    rows = vectors.select("node", "embedding").mapInArrow(moments, "slot int, moment binary").groupBy("slot").applyInArrow(added, "moment binary").collect()  # SUMS at most
    total = sum((np.frombuffer(r.moment, np.float64) for r in rows), np.zeros(dimension * dimension)).reshape(dimension, dimension)
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def tiled(vectors: DataFrame, basis: np.ndarray, rows: int, tile_rows: int) -> DataFrame:
    """vectors (node, copies, embedding) with tile (slab, part, piece) and its leading coordinates (array)."""
    leading = np.pad(basis[:, :BOX], ((0, 0), (0, max(0, BOX - basis.shape[1]))))
    shared = vectors.sparkSession.sparkContext.broadcast(leading)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = unit_rows(_matrix(batch.column("embedding"))) @ shared.value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lead), pa.list_(pa.float64()))], names=[*batch.schema.names, "lead"])

    df = stored(vectors.mapInArrow(turned, f"{_ddl(vectors)}, lead array<double>"), "vectors-turned")
    tiles = -(-rows // tile_rows)
    slabs = max(1, round(tiles**0.5))
    parts = -(-tiles // slabs)
    cuts = lambda k, n: F.percentile_approx(F.col("lead")[k], F.array(*[F.lit(i / n) for i in range(1, n)]), 1000)
    df = df.withColumn("slab", F.lit(0))
    if slabs > 1:
        edges = df.agg(cuts(0, slabs).alias("c")).first().c  # slabs numbers
        df = df.withColumn("slab", F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, c: n + (F.col("lead")[0] > c).cast("int")))
    df = df.withColumn("part", F.lit(0))
    if parts > 1:
        inner = F.broadcast(df.groupBy("slab").agg(cuts(1, parts).alias("c")))  # a row a slab
        df = df.join(inner, "slab").withColumn("part", F.aggregate("c", F.lit(0), lambda n, c: n + (F.col("lead")[1] > c).cast("int"))).drop("c")
    # vectors that share their leading coordinates can overfill a tile
    sizes = F.broadcast(df.groupBy("slab", "part").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("pieces")))  # a row for tile_rows vectors
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    return df.join(sizes, ["slab", "part"]).withColumn("piece", piece).drop("pieces")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


TILE = ("slab", "part", "piece")


def near_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """a, b (tile numbers, a <= b) of the tiles whose boxes are no further apart than vectors that link can be."""
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    boxes = tiles.groupBy("tile", *TILE).agg(*[f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(BOX) for n, f in (("low", F.min), ("high", F.max))])
    boxes = stored(boxes, "vectors-boxes")
    slabs = boxes.groupBy("slab").agg(F.min("low0").alias("low"), F.max("high0").alias("high"))
    known = slabs.collect()  # the square root of the tiles in number
    pairs = [(x.slab, y.slab) for x in known for y in known if y.low - x.high <= reach and x.low - y.high <= reach]
    beside = F.broadcast(tiles.sparkSession.createDataFrame(pairs, "sx int, sy int"))
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"b.low{k}") - F.col(f"a.high{k}"), F.col(f"a.low{k}") - F.col(f"b.high{k}"))
    apart = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    found = a.join(beside, F.col("a.slab") == F.col("sx")).join(b, F.col("b.slab") == F.col("sy")).where((F.col("a.tile") <= F.col("b.tile")) & (apart <= reach * reach))
    return found.select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))


class Links:
    """Links among `n` vectors, as how many each has (copies counted) and a forest."""

    def __init__(self, n: int):
        self.root, self.degree = np.arange(n), np.zeros(n, np.int64)

    def add(self, u: np.ndarray, v: np.ndarray, copies: np.ndarray) -> None:
        n = len(self.root)
        self.degree += np.bincount(u, copies[v], n).astype(np.int64) + np.bincount(v, copies[u], n).astype(np.int64)
        while len(u):
            a, b = self.root[u], self.root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def compare(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, threshold: float, copies: np.ndarray, step: int = 256) -> Links:
    """Links between the unit vectors x and y (within x if y is None); y's are numbered behind x's."""
    d = basis.shape[0]
    ends = [e for e in (16, 32, 64, 128, 256, 512) if e < d] + [d]

    def turned(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = u @ basis
        rest = np.sqrt(np.maximum(0, np.cumsum((t * t)[:, ::-1], axis=1)[:, ::-1]))
        rest = np.concatenate([rest, np.zeros((len(u), 1))], axis=1)
        # the bound of the first step as one product: leading coordinates and the norm of the rest
        return t, np.concatenate([t[:, : ends[0]], rest[:, ends[0], None]], axis=1).astype(np.float32), rest[:, ends].astype(np.float32)

    tx, first_x, rest_x = turned(x)
    ty, first_y, rest_y = (tx, first_x, rest_x) if y is None else turned(y)
    other, base = (x, 0) if y is None else (y, len(x))
    links = Links(base + len(other))
    for at in range(0, len(x), step):
        lo = at if y is None else 0
        bound = first_x[at : at + step] @ first_y[lo:].T
        i, j = np.divmod(np.flatnonzero(bound.ravel() >= threshold - SLACK), bound.shape[1])
        i, j = i + at, j + lo
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):  # what is gathered at once has a bound
            u, v = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            product = np.zeros(len(u))
            for n, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                product += np.einsum("ij,ij->i", tx[u, a:b], ty[v, a:b])
                on = product + rest_x[u, n] * rest_y[v, n] >= threshold - SLACK
                if not on.all():
                    u, v, product = u[on], v[on], product[on]
            exact = np.einsum("ij,ij->i", x[u], other[v]) >= threshold
            links.add(u[exact], v[exact] + base, copies)
    return links


def tile_links(tiles: DataFrame, pairs: DataFrame, basis: np.ndarray, threshold: float, width: str) -> DataFrame:
    """node, links, root: for each pair of tiles and each vector that has links there how many, and one vector of its tree."""
    kind = np.dtype("<f4" if width == "float" else "<f8")

    def packed(group: pa.Table) -> pa.Table:
        flat = pa.concat_arrays(group.column("embedding").chunks).flatten().to_numpy(zero_copy_only=False).astype(kind)
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"tile": pa.array([group.column("tile")[0].as_py()], pa.int64()), "nodes": blob(group.column("node").to_numpy()), "copies": blob(group.column("copies").to_numpy()), "values": blob(flat)})

    blobs = stored(tiles.select("tile", "node", "copies", "embedding").groupBy("tile").applyInArrow(packed, "tile long, nodes binary, copies binary, values binary"), "vectors-tiles")
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("tile"))
    shared = tiles.sparkSession.sparkContext.broadcast(basis)

    def linked(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["tile"])
        units = [unit_rows(np.frombuffer(r["values"], kind).reshape(-1, len(shared.value))) for r in rows]
        nodes, copies = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("nodes", "copies"))
        links = compare(units[0], units[1] if len(units) > 1 else None, shared.value, threshold, copies)
        on = np.flatnonzero(links.degree)
        return pa.table({"node": nodes[on], "links": links.degree[on], "root": nodes[links.root[on]]})

    return sides.join(blobs, "tile").groupBy("a", "b").applyInArrow(linked, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    width = vectors.schema["embedding"].dataType.elementType.simpleString()
    width = width if width == "float" else "double"
    numbers = F.col("embedding").cast(f"array<{width}>")
    rows = stored(vectors.select("vec_id", F.when(usable(numbers), numbers).alias("embedding")), "vectors")
    good = rows.where("embedding is not null")
    shortest, dimension, count = good.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count(F.lit(1))).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if shortest != dimension:
        good = good.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0).cast(width), F.lit(dimension) - F.size("embedding"))))
    different = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    different = stored(different.withColumn("node", F.monotonically_increasing_id()), "vectors-different")
    basis = principal_components(different, dimension)
    tile_rows = max(256, min(tile_rows, TILE_VALUES // dimension))
    tiles = tiled(different.select("node", "copies", "embedding"), basis, different.count(), tile_rows)
    number = F.shiftleft(F.col("slab").cast("long"), 42) + F.shiftleft(F.col("part").cast("long"), 21) + F.col("piece")
    tiles = stored(tiles.withColumn("tile", number), "vectors-tiled")
    found = stored(tile_links(tiles, near_tiles(tiles, threshold), basis, threshold, width), "vectors-links")
    released(tiles)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v")))
    of = different.select("node", "vec_id", "copies").join(links, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of = of.join(names, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies")
    of = stored(of.join(different.select("node", "embedding"), "node").drop("node"), "vectors-judged")
    return with_judgement(good, rows.where("embedding is null"), of, max(1000, count // HOT_VECTORS))


def with_judgement(good: DataFrame, bad: DataFrame, of: DataFrame, share: int) -> DataFrame:
    """Each row with what its vector was found to be; vectors with many copies are looked up by broadcast."""
    side = lambda df, x: df.select(F.col("embedding").alias(f"v{x}"), F.col("n_links").alias(f"n{x}"), F.col("component_id").alias(f"c{x}"))
    hot = F.broadcast(side(of.where(F.col("copies") > share), 1))
    marked = good.join(hot, F.col("embedding") == F.col("v1"), "left")
    rare = marked.where("v1 is null").join(side(of.where(F.col("copies") <= share), 2), F.col("embedding") == F.col("v2"))
    out = rare.select("vec_id", F.col("n2").alias("n_links"), F.col("c2").alias("component_id"))
    out = out.unionByName(marked.where("v1 is not null").select("vec_id", F.col("n1").alias("n_links"), F.col("c1").alias("component_id")))
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
