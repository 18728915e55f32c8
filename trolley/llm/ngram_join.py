"""Exact Jaccard self-join of documents on five-word shingles, by universe partition and pigeonhole.

Sets come in size bands a quarter apart, so a set links only within its band or to a neighbouring one. For
each pair of neighbouring bands the universe of shingle hashes is cut into segments. If two sets differ in at most d shingles and the
segments of one offer more than d units of capacity, some segment must agree: one unit where the subsets that fall into it
are equal, two where they may differ by one shingle (found through the subset's one-deletion neighbourhood). How many
segments there are and how many of them get deletions is allocated by cost: the fewest signatures that give the needed capacity.
Sets are keyed by 128 bits of their digest, so exact copies are one member; a task signs the copies that it meets once.

Signatures are shuffled once, in groups of bounded size. A segment value with few members gives its pairs; one with many is skipped for
sets that have capacity to spare without it, and otherwise worked off in rounds: pivots are compared
with the members of other components, and what has become one component needs no further comparison. From the second round on all that are
left are compared at once if their pairs are few. Sets that meet in many buckets are a
pair in one of them: each carries its first buckets, and a pair that is known from an earlier one is left out. Before whole sets are
compared, pairs must pass a bound that is exact: each set carries the parities of the numbers of its shingles in as many ranges as it
has shingles, about, and as many shingles differ at least as parities do. Sets whose capacity is too small from the start (rare) are
compared as queries, in blocks, with all documents. All candidates are verified on whole sets, that is on the sorted 64-bit hashes of
all their shingles: two shingles with one hash would count as equal.

Nodes are sets, so rows that repeat an id with different texts are separate nodes, and each row gets the smallest id that its own
text reaches. Null and empty texts have empty sets and link with nothing (component_id is the row's own id). A row with a null id links
like any other; it names a component only if all ids there are null. A text of any length is one set in one task. Columns other than doc_id
and text are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm.common import key_filter, lower_words, mapped, passing, released, shingle_hashes, stored, task_memory_released, text_or_empty, thinned
from trolley.llm.components import components
from trolley.llm.tokens import texts_in

#: Groups of signatures at least, so that documents and signatures are dealt evenly.
LEAST_GROUPS = 32
#: A segment value with more members than this is a hot one.
FEW = 8
#: So many buckets of a set say in which one two sets meet first.
LISTED = 16
#: After the first round of pivots all that are left in a bucket are compared, if these are so many pairs at most for each member, or so many in all.
PAIRS_EACH, PAIRS_LEFT = 512, 64_000_000
#: Longs of parities at most; a set of n shingles has n / 64 of them, as a power of two.
PARITY_LONGS = 32
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    x = (x ^ (x >> np.uint64(29))) * _K3
    return x ^ (x >> np.uint64(32))


def needed(n: int) -> int:
    """Capacity that finds every partner of n to 1.25 n shingles: one more than the largest difference at similarity 0.8."""
    return (n + n * 5 // 4) // 9 + 1


def needed_column(n: Column) -> Column:
    return F.floor((n + F.floor(n * 5 / 4)) / 9) + 1


@lru_cache(None)
def band_edges(top: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < top:
        edges.append(edges[-1] * 5 // 4 + 1)
    return edges


def _capacity(n: int, segments: int, doubled: int) -> tuple[float, float]:
    """Mean and deviation of the capacity of a set of n shingles."""
    rate = n / segments
    one, two = 1 - math.exp(-rate), 1 - math.exp(-rate) * (1 + rate)
    return segments * one + doubled * two, math.sqrt(segments * one * (1 - one) + doubled * two * (1 - two))


@lru_cache(None)
def allocation(band: int) -> tuple[int, int]:
    """(segments, doubled segments) for the sets of a band and the next one: the cheapest that falls short about once in ten million sets."""
    edges = band_edges()
    low, high = edges[band], edges[band + 1] - 1
    if needed(high) == 1:
        return 0, 0  # only equal sets can link
    best = None
    for per_segment in (0.5, 1.0, 1.5, 2.0, 2.4, 2.8, 3.1, 3.4, 3.7, 4.0):
        segments = math.ceil(high / per_segment) + 1
        for share in (0, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.4, 0.7, 1.0):
            doubled = math.ceil(share * segments)
            short = any(m - 5.2 * d < needed(n) for n in {low, high} for m, d in [_capacity(n, segments, doubled)])
            cost = segments + doubled * (1 + high / segments)
            if not short and (best is None or cost < best[0]):
                best = cost, segments, doubled
    return best[1:] if best else (4 * high, 4 * high)


class Signatures:
    """The signatures of many sets at once, for their role as lower and as upper band of a pair of bands."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []

    def add(self, own: np.ndarray, set_id: int) -> None:
        self.sets.append(own)
        self.ids.append(set_id)
        return len(own)

    def made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, ids with the lowest bit set for the lower role, capacity of each set)."""
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        edges = np.array(band_edges(), dtype=np.int64)
        bands = np.searchsorted(edges, sizes, side="right") - 1
        every = np.concatenate(self.sets)
        ids = np.array(self.ids, dtype=np.uint64)
        mixed = _mixed(every)
        high = every >> np.uint64(32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sigs, owners, capacity = [], [], np.zeros(len(sizes), dtype=np.int64)
        for lower in (1, 0):
            pair = bands - (0 if lower else 1)
            plan = np.array([allocation(int(b)) if b >= 0 else (0, 0) for b in pair], dtype=np.int64).reshape(-1, 2)
            on = plan[owner, 0] > 0
            if not on.any():
                continue
            who, c = owner[on], mixed[on]
            segment = ((high[on] * plan[who, 0].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)  # ranges of the hash: in order already
            new = np.ones(len(who), dtype=bool)
            new[1:] = (who[1:] != who[:-1]) | (segment[1:] != segment[:-1])
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(c, starts)
            count = np.diff(np.append(starts, len(who)))
            place = (pair[who[starts]].astype(np.uint64) << np.uint64(40)) + segment[starts].astype(np.uint64)
            salt = _mixed(place * _K1 + np.uint64(1))
            sigs.append(_mixed(sums + salt))
            owners.append(ids[who[starts]] | np.uint64(lower))
            twice = (segment[starts] < plan[who[starts], 1]) & (count >= 2)
            if lower:
                capacity += np.bincount(who[starts], minlength=len(sizes)) + np.bincount(who[starts], weights=twice, minlength=len(sizes)).astype(np.int64)
            each = np.repeat(np.arange(len(starts)), count)
            pick = twice[each]
            sigs.append(_mixed(sums[each[pick]] - c[pick] + salt[each[pick]]))
            owners.append(ids[who[pick]] | np.uint64(lower))
        if not sigs:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), capacity
        return np.concatenate(sigs), np.concatenate(owners), capacity


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(lower_words(text)))


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers, the first one even."""
    digest = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True) & ~1, int.from_bytes(digest[8:], "little", signed=True)


def parities(own: np.ndarray) -> np.ndarray:
    """Of each range of the hash whether it holds an odd number of the set's shingles, as 64-bit numbers."""
    longs = 1
    while longs < PARITY_LONGS and 64 * longs < len(own):
        longs *= 2
    odd = np.bincount((own >> np.uint64(8) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def close_enough(n: Column, other_n: Column, parity: Column, other_parity: Column) -> Column:
    """False only where sizes or parities rule the similarity out; the longer parities are folded to the length of the others."""
    size, other_size = F.size(parity), F.size(other_parity)
    folded = lambda x, have, want: F.when(have <= want, x).otherwise(F.zip_with(
        F.slice(x, 1, want), F.slice(x, want + 1, want), lambda a, b: a.bitwiseXOR(b)))
    differ = F.aggregate(
        F.zip_with(folded(parity, size, other_size), folded(other_parity, other_size, size), lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0), lambda acc, x: acc + x)
    alike = F.least(n, other_n) * 5 >= F.greatest(n, other_n) * 4
    far = F.greatest(size, other_size) > 2 * F.least(size, other_size)  # not with sizes alike
    return F.when(~alike | far, False).otherwise(differ * 9 <= n + other_n)


def _packed_sigs(sigs: np.ndarray) -> bytes:
    """The low 40 bits of signatures; their group is dealt by the others. Some millions in a group agree by chance in a few pairs, which verification drops."""
    return sigs.astype(np.uint32).tobytes() + (sigs >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked_sigs(blob: pa.Buffer) -> np.ndarray:
    n = blob.size // 5
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as the sets that occur, and how often each does without and with the lowest bit, in one byte where that is enough."""
    sets = ids & ~np.uint64(1)
    starts = np.flatnonzero(np.append(True, sets[1:] != sets[:-1]))
    lower = np.add.reduceat((ids & np.uint64(1)).astype(np.int64), starts)
    counts = np.stack([np.diff(np.append(starts, len(ids))) - lower, lower], axis=1)
    return np.uint64(len(starts)).tobytes() + sets[starts].tobytes() + counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _unpacked_ids(blob: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint64, 1)[0])
    sets, width = np.frombuffer(blob, np.uint64, n, 8), (blob.size - 8 * (n + 1)) // (2 * n)
    return np.repeat(np.stack([sets, sets | np.uint64(1)], axis=1).ravel(), np.frombuffer(blob, f"u{width}", 2 * n, 8 * (n + 1)).astype(np.int64))


def bucket_members(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures shared by two or more sets: (signatures, ids, index of each bucket's first row), sorted."""
    order = np.argsort(sigs)
    sigs, ids = sigs[order], ids[order]
    same = sigs[1:] == sigs[:-1]
    shared = np.zeros(len(sigs), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    sigs, ids = sigs[shared], ids[shared]
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    last = np.ones(len(sigs), dtype=bool)  # of rows alike but for the role the one with the role bit stays
    last[:-1] = (sigs[1:] != sigs[:-1]) | (ids[1:] >> np.uint64(1) != ids[:-1] >> np.uint64(1))
    sigs, ids = sigs[last], ids[last]
    starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])) if len(sigs) else np.zeros(0, np.int64)
    return sigs, ids, starts


def _index_schema(doc_id: T.StructField) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("kind", T.IntegerType()), doc_id, T.StructField("n", long), T.StructField("capacity", long),
                         T.StructField("a", long), T.StructField("b", long), T.StructField("text_hash", long), T.StructField("parity", T.ArrayType(long))])


def group_count(docs: DataFrame, part_bytes: int = 16 << 20) -> int:
    """Groups of about part_bytes of signatures, which take about as many bytes as the texts."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty().cast("binary")))).first()[0] or 0
    return -(-size * 5 // 4 // part_bytes)


def index(docs: DataFrame, parts: int, flush: int = 1 << 20) -> DataFrame:
    """One table of three kinds of rows, stored: 0 documents (a, b: set key), 1 pairs of sets (a, b), 2 members b of hot buckets a of n members.

    Signatures go to the groups in blobs, one for each group that a flush has any for, so there are never more of them than
    signatures. Documents are dealt to the groups in turn: they need no company.
    """
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    name = docs.schema["doc_id"]
    out = _index_schema(name)
    sent = T.StructType([T.StructField("part", T.IntegerType()), *out.fields[1:], T.StructField("sigs", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[tuple[int, int], int] = {}  # capacity of the sets that this task has signed lately
        turn = 0

        def flushed(id_type: pa.DataType) -> pa.RecordBatch:
            sigs = np.concatenate([k[0] for k in kept])
            known, ids = np.unique(np.concatenate([k[1] for k in kept]), return_inverse=True)
            ids = ids.astype(np.uint64)  # members are numbers in the list of the sets seen since the last flush
            kept.clear()
            part = (sigs >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part << np.uint64(32) | ids)  # a set's signatures side by side
            own, starts = np.unique(part[order], return_index=True)
            pieces = np.split(order, starts[1:])[: len(own)]
            n = len(own)
            columns = [pa.array(own.astype(np.int32)), *(pa.nulls(n, t) for t in (id_type, *[pa.int64()] * 5, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([_packed_sigs(sigs[i]) for i in pieces], pa.binary()), pa.array([_packed_ids(known[ids[i]]) for i in pieces], pa.binary())],
                names=sent.names)

        def close(group: Signatures, members: list[tuple[int, int]]) -> None:
            if group.sets:
                sigs, ids, own = group.made()
                seen.update(zip(members, own.tolist(), strict=True))
                kept.append((sigs, ids))

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            sizes, keys, parity = [], [], []
            group, held, members = Signatures(), 0, []
            if len(seen) > 50_000:
                seen.clear()
            for text in texts_in(batch):
                own = shingle_set(text)
                key = set_key(own)
                sizes.append(len(own)), keys.append(key), parity.append(parities(own))
                if len(own) and key not in seen:
                    seen[key] = 0
                    group.add(own, key[0] & (1 << 64) - 1)
                    members.append(key)
                    held += len(own)
                if held > 200_000:
                    close(group, members)
                    group, held, members = Signatures(), 0, []
                    if sum(len(k[0]) for k in kept) > flush:
                        yield flushed(id_type)
            close(group, members)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.arange(turn, turn + n) % parts).astype(np.int32)), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array([seen.get(k, 0) for k in keys], pa.int64()),
                 pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column("text_hash"),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parity)]), pa.int32()), pa.array(np.concatenate([*parity, np.zeros(0, np.int64)]))),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                names=sent.names)
            turn += n
        if kept:
            yield flushed(id_type)
        task_memory_released()

    def paired(group: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        documents = group.filter(pa.compute.is_valid(group.column("n"))).select(out.names[1:])
        documents = documents.add_column(0, "kind", pa.array(np.zeros(documents.num_rows, np.int32)))
        place = np.uint64((group.column("part")[0].as_py() + 1) * int(_K1) & (1 << 64) - 1)
        blobs = group.select(["sigs", "ids"]).filter(pa.compute.is_valid(group.column("sigs")))
        del group
        sigs = np.concatenate([none, *(_unpacked_sigs(x.as_buffer()) for x in blobs.column("sigs"))])
        ids = np.concatenate([none, *(_unpacked_ids(x.as_buffer()) for x in blobs.column("ids"))])
        del blobs
        sigs, ids, starts = bucket_members(sigs, ids)
        count = np.diff(np.append(starts, len(sigs)))
        left, right = [], []
        for k in range(2, FEW + 1):
            at = starts[count == k]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = ids[at + i], ids[at + j]
                    some = ((x | y) & np.uint64(1)) == 1  # two upper ones meet as lower ones elsewhere
                    left.append(x[some] & ~np.uint64(1)), right.append(y[some] & ~np.uint64(1))
        pairs = np.unique(np.stack([np.concatenate([*left, none]), np.concatenate([*right, none])], axis=1).astype(np.uint64), axis=0)
        hot, count = np.repeat(count > FEW, count), np.repeat(count, count)
        made = []
        for kind, a, b, n in ((1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)), (2, _mixed(sigs[hot] + place), ids[hot], count[hot])):
            columns = {"kind": pa.array(np.full(len(a), kind, np.int32)), "n": pa.array(n.astype(np.int64)), "a": pa.array(a.astype(np.uint64).view(np.int64)), "b": pa.array(b.astype(np.uint64).view(np.int64))}
            made.append(pa.table([columns.get(f.name, pa.nulls(len(a), f.type)) for f in documents.schema], schema=documents.schema))
        result = pa.concat_tables([documents, *made])
        task_memory_released()
        return result

    return stored(mapped(texts, signed, sent).groupBy("part").applyInArrow(paired, out), "ngram-index")


def wanted_sets(docs: DataFrame, wanted: DataFrame, files: int) -> DataFrame:
    """set_id, node, n, shingles of the classes in wanted (set_id, set_hi, node), stored.

    A class is read from one of its rows: that with the id and text hash of its node. Rows that share both are one before any shuffle.
    """
    schema = T.StructType([wanted.schema["set_id"], wanted.schema["node"], T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts_in(batch)]
            keys = list(zip(batch.column("set_id").to_pylist(), batch.column("set_hi").to_pylist(), strict=True))
            own = pa.array([set_key(s) == k for s, k in zip(sets, keys, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), batch.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names).filter(own)
        task_memory_released()

    keys = wanted.select("set_id", "set_hi", "node", F.col("node.doc_id").alias("doc_id"), F.col("node.text_hash").alias("text_hash"))
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = passing(texts, key_filter(keys, "doc_id", "text_hash"), "doc_id", "text_hash").groupBy(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.first("text").alias("text"))
    texts = texts.join(keys, F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_hash") == F.col("text_hash"))).select("set_id", "set_hi", "node", "text")
    return stored(mapped(texts, read, schema).coalesce(files), "ngram-sets")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b: set ids) whose sets reach the similarity, as edges (u, v) of nodes; only sets of pairs are shuffled."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    own = passing(sets, key_filter(pairs.select(F.explode(F.array("a", "b")).alias("set_id")), "set_id"), "set_id")
    side = lambda of, node, shingles: own.select(F.col("set_id").alias(of), F.col("node").alias(node), F.col("shingles").alias(shingles))
    full = pairs.join(side("a", "u", "x"), "a").join(side("b", "v", "y"), "b").select("u", "v", "x", "y")
    node = sets.schema["node"].dataType
    return mapped(full, verify, T.StructType([T.StructField("u", node), T.StructField("v", node)]))


def query_blocks(docs: DataFrame, sets: DataFrame, block_bytes: int = 16 << 20) -> DataFrame | None:
    """Links between the sets given and all documents (node, set_id, set_hi): each block of sets is a query that every document answers."""
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    found = None
    n = -(-total // block_bytes)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("of", "set_id", "set_hi")])
    for k in range(n):
        block = [(r.set_id, bytes(r.shingles)) for r in sets.where(F.pmod(F.xxhash64("set_id"), F.lit(n)) == k).collect()]

        def answer(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            queries = [(r, np.frombuffer(s, np.uint64)) for r, s in block]
            for batch in batches:
                rows = []
                for text in texts_in(batch):
                    own = shingle_set(text)
                    for r, s in queries:
                        if len(own) and 5 * min(len(own), len(s)) >= 4 * max(len(own), len(s)):
                            both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                            if 100 * both >= 80 * (len(own) + len(s) - both):
                                rows.append((r, *set_key(own)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], names=schema.names)

        part = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(answer, schema).distinct()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return None
    return found.join(sets.select(F.col("set_id").alias("of"), F.col("node").alias("u")), "of").select("u", "set_id", "set_hi")


def _asked(members: DataFrame, classes: DataFrame, files: int) -> DataFrame:
    """The hot buckets that have to be worked off: bucket, id, asks, and weight, n, parity of each member.

    Hot buckets are left out of a set's capacity. A set that has too little without them takes back as many as it lacks, those with
    the fewest members; in these it asks, that is it needs all its partners.
    """
    met = members.groupBy(F.col("id").alias("set_id")).agg(F.array_sort(F.collect_set(F.struct((~F.col("lower")).alias("upper"), "size", "bucket"))).alias("met"))
    lost = F.size(F.filter("met", lambda m: ~m["upper"]))
    lacks = needed_column(F.col("n")) - (F.col("capacity") - lost)
    sets = classes.join(met, "set_id").select(F.col("set_id").alias("id"), F.size("met").alias("weight"), "n", "parity", lacks.alias("lacks"), "met")
    sets = stored(sets.coalesce(files), "ngram-hot-sets")
    each = sets.select("id", "weight", "n", "parity", "lacks", F.posexplode("met").alias("place", "at"))
    each = each.select("at.bucket", "id", (~F.col("at.upper") & (F.col("place") < F.col("lacks"))).alias("asks"), "weight", "n", "parity")
    return each.join(each.where("asks").select("bucket").distinct(), "bucket", "left_semi")


def _listed(rows: DataFrame) -> DataFrame:
    """The rows (bucket, id, component, asks, n, parity) with the first buckets of each id: `met` of all, `asked` of those in which it asks.

    Two sets that both carry a bucket, in which one of them asks, are a pair there; in later buckets they needn't be another one. A pair is always
    made in the first bucket that both have, whether it is carried or not.
    """
    sets = rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("component", "n", "parity")], F.array_sort(F.collect_set(F.struct("bucket", "asks"))).alias("places"))
    buckets = lambda x: F.transform(x, lambda p: p["bucket"])
    sets = sets.withColumns({
        "folded": F.aggregate("parity", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)),
        "met": buckets(F.slice("places", 1, LISTED)), "asked": buckets(F.slice(F.filter("places", lambda p: p["asks"]), 1, LISTED))})
    return sets.withColumn("place", F.explode("places")).select("place.bucket", "id", "component", "place.asks", "n", "folded", "parity", "met", "asked")


def _first_meetings(pivots: DataFrame, now: DataFrame, all_left: bool = False) -> DataFrame:
    """a, b: pivots and members of the open buckets (bucket, id, component, asks, n, parity) that could be alike; twice only where the lists of buckets
    are cut, or where both are pivots. all_left: pivots and members are the same.
    """
    p = _listed(pivots).select(*[F.col(c).alias(f"p_{c}") for c in ("bucket", "id", "component", "asks", "n", "folded", "parity", "met", "asked")])
    before = lambda x: F.filter(x, lambda b: b < F.col("bucket"))
    apart = F.col("p_id") < F.col("id") if all_left else F.col("p_id") != F.col("id")
    alike = F.least("n", "p_n") * 5 >= F.greatest("n", "p_n") * 4
    alike &= F.bit_count(F.col("folded").bitwiseXOR(F.col("p_folded"))) * 9 <= F.col("n") + F.col("p_n")  # what close_enough finds, but sooner
    pairs = p.join(_listed(now), (F.col("p_bucket") == F.col("bucket")) & apart & (F.col("p_component") != F.col("component")) & (F.col("p_asks") | F.col("asks")) & alike
                   & close_enough(F.col("n"), F.col("p_n"), F.col("parity"), F.col("p_parity"))
                   & ~F.arrays_overlap(before("p_met"), "asked") & ~F.arrays_overlap(before("p_asked"), "met"))
    return pairs.select(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b"))


def _open(hot: DataFrame, labels: DataFrame, files: int) -> tuple[DataFrame | None, int, int]:
    """(members of the buckets that aren't done, with their components; their number; pairs to compare at most). Buckets of one component, or in which none asks, are done."""
    now = hot.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    buckets = now.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count_if("asks").alias("askers"), F.count(F.lit(1)).alias("rows"))
    buckets = stored(buckets.where((F.col("c0") != F.col("c1")) & (F.col("askers") > 0)).select("bucket", "askers", "rows").coalesce(files), "ngram-buckets")
    rows, pairs = buckets.agg(F.sum("rows"), F.sum(F.col("askers") * F.col("rows"))).first()
    if rows:
        now = stored(now.join(buckets.select("bucket"), "bucket", "left_semi").coalesce(files), "ngram-hot")
    released(buckets)
    return (now, rows, pairs) if rows else (None, 0, 0)


def _pivots(now: DataFrame, slots: int, files: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs to compare, members left, pivots): pivots of each bucket against its members in other components.

    A bucket's members fall into slots by hash, and each slot's heaviest is a pivot: one row a slot leaves each task.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    first = now.groupBy("bucket", slot.alias("slot")).agg(
        F.max_by(F.struct("id", "component", "asks", "n", "parity"), F.struct("weight", "id")).alias("p")).select("bucket", "p.*")
    first = stored(first.coalesce(files), "ngram-pivots")
    pairs = stored(_first_meetings(first, now).distinct().coalesce(files), "ngram-pairs")
    return pairs, now.join(first.select("bucket", "id"), ["bucket", "id"], "left_anti").drop("component"), first


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, reps = _components(docs)
    return rows.join(reps, ["set_id", "set_hi"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component.doc_id")).alias("component_id"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set key and text hash of every row; node and component of each set that isn't empty).

    A node is a set: no_id, doc_id, text_hash, set key of its row with the smallest id, null ids last. They compare in that order, so the
    least node of a component has its smallest id.
    """
    groups = group_count(docs)
    found = index(docs, max(LEAST_GROUPS, groups))
    files = max(8, 2 * groups)  # of a table at most; those of the rounds are small
    rows = found.where(F.col("kind") == 0).select("doc_id", F.col("n").alias("n_shingles"), "capacity", F.col("a").alias("set_id"), F.col("b").alias("set_hi"), "text_hash", "parity")
    node = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "set_id", "set_hi")
    classes = stored(rows.where(F.col("n_shingles") > 0).groupBy("set_id", "set_hi").agg(
        F.min(node).alias("node"), F.first("n_shingles").alias("n"), F.max("capacity").alias("capacity"), F.first("parity").alias("parity")).coalesce(files), "ngram-classes")
    side = lambda x: classes.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    met = found.where(F.col("kind") == 1).select("a", "b").distinct().join(side("a"), "a")
    right = side("b").withColumnRenamed("b", "to")
    pairs = stored(met.join(right, (F.col("b") == F.col("to")) & close_enough(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))).select("a", "b").coalesce(files), "ngram-pairs")

    # hot buckets: skipped by the sets whose other segments suffice
    members = found.where(F.col("kind") == 2).select(
        F.col("a").alias("bucket"), F.col("b").bitwiseAND(F.lit(-2)).alias("id"), (F.col("b") % 2 != 0).alias("lower"), F.col("n").alias("size"))
    hot = stored(_asked(members, classes, files).coalesce(files), "ngram-hot")

    need = needed_column(F.col("n"))
    short = classes.where((need > 1) & (F.col("capacity") < need))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(
        hot.select(F.col("id").alias("set_id"))).unionByName(short.select("set_id")).distinct()
    wanted = stored(classes.join(ids, "set_id", "left_semi").select("set_id", "set_hi", "node").coalesce(files), "ngram-wanted")
    sets = wanted_sets(docs, wanted, files)
    edges = stored(linked(pairs, sets).coalesce(files), "ngram-links")
    rooted = lambda labels: labels.select(F.col("node.set_id").alias("id"), F.col("component.set_id").alias("component"))
    asked = query_blocks(docs, sets.join(short.select("set_id"), "set_id", "left_semi"))
    if asked is not None:
        edges = stored(edges.unionByName(asked.join(classes.select("set_id", "set_hi", F.col("node").alias("v")), ["set_id", "set_hi"]).select("u", "v")), "ngram-links")
    labels = components(edges)
    slots, found_any, old = 1, True, [hot]
    while hot is not None:
        now, members_left, most = _open(hot, rooted(labels), files)
        released(*old)
        if now is None:
            break
        if slots > 1 and (most <= max(PAIRS_LEFT, PAIRS_EACH * members_left) or not found_any):
            more, hot, old = stored(_first_meetings(now, now, all_left=True).distinct().coalesce(files), "ngram-pairs"), None, [now]
        else:
            more, hot, first = _pivots(now, slots, files)
            old = [now, first]
        slots *= 8
        new = stored(linked(more, sets).coalesce(files), "ngram-links")
        found_any = not new.isEmpty()
        if found_any:  # join the components that the new links touch
            of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
            met = new.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
            merged = components(met)
            moved = labels.join(merged.withColumnRenamed("component", "now").withColumnRenamed("node", "component"), "component", "left")
            moved = moved.select("node", F.coalesce("now", "component").alias("component"))
            labels = stored(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")).coalesce(files), "components")
        released(more, new)
    reps = classes.join(labels, "node", "left").select("set_id", "set_hi", "node", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "n_shingles", "set_id", "set_hi", "text_hash"), reps


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component; all columns stay.

    It is the row with the component's smallest id (null ids last); where rows repeat that id and set, the one with the
    least hash of all columns. Rows without words stay. What goes is decided by id, text hash and set, so that a row is
    never lost because another one has its id.
    """
    rows, reps = _components(docs)
    root = F.col("component") == F.col("node")
    same_text = F.col("node.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("node.text_hash") == F.col("text_hash"))
    judged = rows.join(reps, ["set_id", "set_hi"]).groupBy("doc_id", "text_hash").agg(
        F.max(root & same_text).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = stored(judged.where(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "text_hash", "stays"), "ngram-copies")
    return thinned(docs, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(text_or_empty().cast("binary"))}, odd)
