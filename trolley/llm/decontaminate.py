"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size. For each size class a document is seen as overlapping windows a little
longer than the items of the class, whose MinHash values come from block minima shared by all classes, so a short item is
compared with sets of its own size wherever it lies in a long document. An item is a candidate of a document when a
window shares one of its `permutations` MinHash values. Candidates are verified on whole texts: the share of the item's distinct
shingles that occur in the document must reach the threshold.

Items of so few shingles that all of them must occur (four, at 0.8) are found by one of these, looked up exactly; windows might miss them.

Words are lower-cased (A-Z) and lose ASCII punctuation; shingles are runs of five words. An item of one to four words is one
shingle, looked for as a run of words. A null or empty text contains nothing, an empty item is in nothing. Null ids stay null;
rows that repeat give rows that repeat. Empty tables give no rows. The other columns of either table are ignored.

Items go to the tasks in blocks of at most `block_bytes` of text (a single longer item is a block), each block one pass over the documents;
a worker builds a block's index once. Ids are of any type. A text of any length is searched in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trolley.llm.common import SHINGLE_WORDS, mapped, shingle_hashes, task_memory_released, text_or_empty
from trolley.llm.tokens import texts_in

THRESHOLD = 0.8
BASE = 8  # shingles in a block; windows are whole blocks
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split() if text else []


def _permutations(n: int) -> np.ndarray:
    """Odd multipliers; a product's high bits order the shingles anew."""
    return (np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def window_blocks(size: int) -> int:
    """Blocks in the windows of an item's size class: enough for any run of that many shingles, classes a quarter apart."""
    need, blocks = -(-size // BASE) + 1, 2
    while blocks < need:
        blocks = max(blocks + 1, blocks * 5 // 4)
    return blocks


class ItemIndex:
    """MinHash values of a block of items by size class, with a bit table in front of them."""

    table_bits = 20

    def __init__(self, items: list[tuple[object, bytes]], permutations: int, threshold: float):
        self.mult = _permutations(permutations)
        self.threshold = threshold
        self.ids, self.sets, self.classes, self.short = [], [], {}, {}
        whole: dict[int, list[int]] = {}  # by one shingle: items that need all of theirs
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            i = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(np.unique(shingle_hashes(words)))
            if len(words) < SHINGLE_WORDS:
                self.short.setdefault(len(words), []).append(i)
            elif threshold * len(self.sets[i]) > len(self.sets[i]) - 1 + 1e-9:
                whole.setdefault(int(self.sets[i][0]), []).append(i)
            else:
                self.classes.setdefault(window_blocks(len(self.sets[i])), []).append(i)
        shift = np.uint64(64 - self.table_bits)
        bits = np.zeros(1 << self.table_bits, dtype=bool)
        bits[(np.array(list(whole), dtype=np.uint64) >> shift)] = True
        self.whole = bits, whole, shift
        for blocks, members in self.classes.items():
            values = np.array([[(self.sets[i] * m).min() for m in self.mult] for i in members], dtype=np.uint64)
            bits = np.zeros(1 << self.table_bits, dtype=bool)
            bits[(values >> shift).ravel()] = True
            owners: dict[int, list[int]] = {}
            for i, row in zip(members, values.tolist(), strict=True):
                for v in row:
                    owners.setdefault(v, []).append(i)
            self.classes[blocks] = (bits, owners, shift)

    def candidates(self, shingles: np.ndarray) -> set[int]:
        n = len(shingles)
        starts = np.arange(0, n, BASE)
        minima = np.empty((len(self.mult), len(starts)), dtype=np.uint64)
        for k, m in enumerate(self.mult):
            minima[k] = np.minimum.reduceat(shingles * m, starts)
        bits, whole, shift = self.whole
        found = {i for v in np.unique(shingles[bits[shingles >> shift]]).tolist() for i in whole.get(v, ())} if whole else set()
        for blocks, (bits, owners, shift) in self.classes.items():
            low, reach = minima, 1  # the minimum over `blocks` neighbours, by doubling
            while reach < blocks and low.shape[1] > 1:
                step = min(reach, blocks - reach, low.shape[1] - 1)
                low = np.minimum(low[:, step:], low[:, :-step])
                reach += step
            hit = low[bits[low >> shift]]
            for v in np.unique(hit).tolist():
                found.update(owners.get(v, ()))
        return found

    def contained(self, text: bytes) -> list[tuple[int, int]]:
        """(item, shingles found) of the items that the text contains to the threshold."""
        threshold = self.threshold
        words = plain_words(text)
        out = []
        if len(words) >= SHINGLE_WORDS and len(self.ids) > sum(map(len, self.short.values())):
            shingles = shingle_hashes(words)
            found = self.candidates(shingles)
            if found:
                own = np.unique(shingles)
                for i in sorted(found):
                    s = self.sets[i]
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    both = int((own[at] == s).sum())
                    if both >= threshold * len(s) - 1e-9:
                        out.append((i, both))
        for k, members in self.short.items():
            if len(words) >= k:
                runs = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
                known = {int(shingle_hashes(list(r))[0]) for r in runs}
                out += [(i, 1) for i in members if int(self.sets[i][0]) in known]
        return out


_built: dict[str, ItemIndex] = {}


def built(name: str, items: list[tuple[object, bytes]], permutations: int, threshold: float) -> ItemIndex:
    """The index of a block, made once for each worker, which keeps the last one only."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemIndex(items, permutations, threshold)
    return _built[name]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size; one block is in the driver at a time."""
    t = text_or_empty()
    rows = items.select("item_id", t.cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, bytes(r.text)) for r in part.collect()]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, permutations: int = 32, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, item_shingles, found_shingles, containment for every document that contains an item."""
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("item_shingles", T.LongType()),
                           T.StructField("found_shingles", T.LongType())])
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    spark = docs.sparkSession

    def search(block: list[tuple[object, bytes]]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built(name, shared.value, permutations, threshold)
            for batch in batches:
                row, ids, sizes, found = [], [], [], []
                for i, text in enumerate(texts_in(batch)):
                    for item, both in index.contained(text):
                        row.append(i), ids.append(index.ids[item]), sizes.append(len(index.sets[item])), found.append(both)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(ids, arrow_type), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                    names=["doc_id", "item_id", "item_shingles", "found_shingles"])
            task_memory_released()

        return mapped(texts, scan, schema)

    arrow_type = to_arrow_type(items.schema["item_id"].dataType)
    passes = [search(block) for block in item_blocks(items, block_bytes)]
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
    return found.withColumn("containment", F.col("found_shingles") / F.col("item_shingles"))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, permutations: int = 32, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without those that contain a benchmark item; all columns stay."""
    def kept(docs: DataFrame, block: list[tuple[object, bytes]]) -> DataFrame:
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built(name, shared.value, permutations, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not index.contained(t) for t in texts_in(batch)], pa.bool_()))
            task_memory_released()

        return mapped(docs, scan, docs.schema)

    return reduce(kept, item_blocks(items, block_bytes), docs)
