"""Frequent phrases of two to five words, and how much more often they occur than their parts would by chance.

Texts are cut at marks into pieces and those into words; a phrase never crosses a piece. Counts are by language. Every word starts a suffix,
cut off after five words. Three passes over the texts, each of which sends on less:

1. Words are counted. Those with fewer than `least` occurrences end a suffix; a bitmap of the others goes to the tasks.
2. Pairs of frequent words are counted by hash. The bitmap of frequent pairs cuts suffixes shorter still.
3. The suffixes that are left (of two words and more) are summed in each task and routed by their first two words, so that all suffixes of a
   pair meet, summed, in one place. There a multikey three-way quicksort of pointers to them partitions by the first word, then the equal part by
   the next word and so on, to the last word: the size of an equal part is a phrase's count, and parts that are infrequent
   as a whole are abandoned. Pairs with over 1 / HOT_PAIRS of all occurrences are routed by three words; their own counts are sums over the places.

Bitmaps are bounded (FILTER_BITS); what passes one by chance is only counted in vain. A word stands for its 64-bit hash (seeded by the language) until
the phrases that stay get their words back. Scores are whole numbers from exact decimals.

Null text: empty. Null lang: `und`. Rows that repeat count each. An empty table gives no rows. A very long text is worked through in
portions. Only text and lang are read; without a column lang all is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import FILTER_BITS, Remembered, mapped, released, stored, task_memory_released, text_or_empty

LEAST, LONGEST, TOP = 100, 5, 2000
HOT_PAIRS = 1000
#: Word totals of so many languages at most go to all tasks.
MANY_LANGS = 10_000
PART_BYTES = 24 << 20
#: Words that a task holds before it sums them.
FLUSH = 500_000
PORTION_PIECES = 50_000
#: Marks that end a piece.
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class LangWords(Remembered):
    """Word to its hash, as xxhash64(lang, word) has it in Spark; 0 stands for no word."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, seed=self.seed)


_by_lang: dict[str, LangWords] = {}


def _words_of(lang: str) -> LangWords:
    if lang not in _by_lang:
        if len(_by_lang) >= 8:
            _by_lang.clear()
        _by_lang[lang] = LangWords(lang)
    return _by_lang[lang]


def _forget() -> None:
    _by_lang.clear()
    task_memory_released()


def pieces(text: bytes) -> list[list[bytes]]:
    return [words for p in text.lower().translate(_CUT).split(b"\n") if (words := p.split())]


def portions(batch: pa.RecordBatch) -> Iterator[tuple[str, list[list[bytes]]]]:
    """(lang, pieces) of the texts of a batch, a long text in several."""
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        found = pieces(text.as_buffer().to_pybytes())
        for at in range(0, len(found), PORTION_PIECES):
            yield lang, found[at : at + PORTION_PIECES]


def hashed(batches: Iterator[pa.RecordBatch], flush: int = FLUSH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, words left in the piece from each on), about `flush` words at a time."""
    ids, left, size = [], [], 0
    for batch in batches:
        for lang, found in portions(batch):
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            n = int(lengths.sum())
            ids.append(np.fromiter(map(_words_of(lang).__getitem__, chain.from_iterable(found)), np.uint64, n))
            left.append(np.repeat(np.cumsum(lengths), lengths) - np.arange(n))
            size += n
            if size >= flush:
                yield np.concatenate(ids), np.concatenate(left)
                ids, left, size = [], [], 0
    if size:
        yield np.concatenate(ids), np.concatenate(left)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        h += (c ^ (c >> np.uint64(31))) * _M[k]
        h ^= h >> np.uint64(29)
        h *= _M[0]
    return h ^ (h >> np.uint64(32))


def _after(a: np.ndarray, k: int) -> np.ndarray:
    """a moved k places to the left; zeros follow."""
    out = np.zeros_like(a)
    out[: max(0, len(a) - k)] = a[k:]
    return out


class Bitmap:
    """A bounded set of hashes, some others pass too: 16 bits for each as a power of two, FILTER_BITS at most."""

    def __init__(self, df: DataFrame, column: str):
        self.bits, rows = 1 << 15, df.count()
        while self.bits < FILTER_BITS and self.bits < 16 * rows:
            self.bits *= 2
        pos = F.col(column).bitwiseAND(F.lit(self.bits - 1)) + 1
        blocks = df.select(pos.alias("pos")).groupBy(F.bitmap_bucket_number("pos").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits"))
        self.bytes = np.zeros(self.bits // 8, np.uint8)
        for r in blocks.collect():  # FILTER_BITS / 8 bytes at most
            at = (r.block - 1) * len(r.bits)
            self.bytes[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)[: self.bits // 8 - at]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        pos = hashes & np.uint64(self.bits - 1)
        return (self.bytes[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 != 0


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of all words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.binary()).view(pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, found in portions(batch):
                held.setdefault(lang, Counter()).update(chain.from_iterable(found))
            if sum(map(len, held.values())) > FLUSH:
                yield from rows()
        yield from rows()
        _forget()

    return mapped(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _blobs(parts: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(part, rows, compressed columns) of rows that are sorted by part."""
    own, starts, sizes = np.unique(parts, return_index=True, return_counts=True)
    for part, a, b in zip(own.tolist(), starts, starts + sizes, strict=True):
        yield part, int(b - a), pa.compress(b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in rows), codec="zstd", asbytes=True)


def _unpacked(group: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    widths = [np.dtype(k).itemsize for k in kinds]
    for n, blob in zip(group.column("rows").to_pylist(), group.column("blob"), strict=True):
        raw, at = pa.decompress(blob.as_buffer(), n * sum(widths), codec="zstd", asbytes=True), 0
        for c, kind, width in zip(columns, kinds, widths, strict=True):
            c.append(np.frombuffer(raw, kind, n, at))
            at += n * width
    return [np.concatenate(c) for c in columns]


_SENT = "part int, rows int, blob binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "rows", "blob"])


def pair_counts(texts: DataFrame, words: Bitmap, parts: int, least: int) -> DataFrame:
    """pair (hash), n of the pairs of frequent words with at least `least` occurrences."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def sent(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return _sent(list(_blobs(((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), [h, n])))

        for ids, left in hashed(batches):
            usual = shared.value.has(ids)
            on = np.flatnonzero((left >= 2) & usual & _after(usual, 1))
            held.append(_summed(mixed([ids[on], ids[on + 1]])))
            if sum(len(h) for h, _ in held) > 2 * FLUSH:
                held = [summed()]
                if len(held[0][0]) > FLUSH:
                    yield sent(*held.pop())
        if held:
            yield sent(*summed())
        _forget()

    def total(group: pa.Table) -> pa.Table:
        h, n = _summed(*_unpacked(group, ["<u8", "<i8"]))
        return pa.table({"pair": h[n >= least].view(np.int64), "n": n[n >= least]})

    return mapped(texts, count, _SENT).groupBy("part").applyInArrow(total, "pair long, n long")


def frequent_prefixes(columns: list[np.ndarray], weights: np.ndarray, least: int, spread: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """(first words, occurrences) of all prefixes of two words and more that `least` of the suffixes have.

    Multikey three-way quicksort: pointers to suffixes are partitioned around the word of a pivot; the equal part goes on with the next
    word. Only parts that are frequent as a whole are partitioned. Pairs of rows in `spread` are left out.
    """
    todo = [(np.arange(len(weights)), 0)] if weights.sum() >= least else []
    while todo:
        pointers, depth = todo.pop()
        words = columns[depth][pointers]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        below, above = words < pivot, words > pivot
        if below.any() or above.any():
            for side in (below, above):
                part = pointers[side]
                if weights[part].sum() >= least:
                    todo.append((part, depth))
            pointers = pointers[~(below | above)]
        n = int(weights[pointers].sum())
        if n >= least and pivot:
            if depth > 1 or depth == 1 and not spread[pointers[0]]:
                yield [int(columns[k][pointers[0]]) for k in range(depth + 1)], n
            if depth + 1 < len(columns):
                todo.append((pointers, depth + 1))


def phrase_counts(texts: DataFrame, words: Bitmap, pairs: Bitmap, hot: np.ndarray, parts: int, least: int, longest: int) -> DataFrame:
    """phrase (array of word hashes), n of the frequent phrases of 2 to `longest` words."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((words, pairs, np.sort(hot)))

    def is_hot(h: np.ndarray) -> np.ndarray:
        hot = shared.value[2]
        return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)

    def suffixes(ids: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """Columns of the words of each suffix that is left, 0 where it has ended."""
        words, pairs, _ = shared.value
        usual = words.has(ids)
        link = (left >= 2) & usual & _after(usual, 1)
        on = np.flatnonzero(link)
        link[on] = pairs.has(mixed([ids[on], ids[on + 1]]))
        columns, goes_on = [ids], link
        for k in range(1, longest):
            columns.append(np.where(goes_on, _after(ids, k), np.uint64(0)))
            goes_on = goes_on & _after(link, k)
        on = np.flatnonzero(link)
        return [c[on] for c in columns]

    def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(place, columns and counts) of different suffixes, sorted by place and first words."""
        pair = mixed(columns[:2])
        route = np.where(is_hot(pair), mixed(columns[:3]) if longest > 2 else pair, pair)
        key = (route & np.uint64(0xFFFFFFFF00000000)) | (mixed(columns) >> np.uint64(32))
        order = np.argsort(key)
        columns, n, key = [c[order] for c in columns], n[order], key[order]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))[: len(n)]
        first = np.flatnonzero(new)
        return ((key[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), [*(c[first] for c in columns), np.add.reduceat(n, first) if len(first) else n]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def merged() -> tuple[np.ndarray, list[np.ndarray]]:
            *columns, n = [np.concatenate(x) for x in zip(*held, strict=True)]
            return summed(columns, n)

        for ids, left in hashed(batches):
            columns = suffixes(ids, left)
            held.append(summed(columns, np.ones(len(columns[0]), np.int64))[1])
            if sum(len(h[-1]) for h in held) > FLUSH:
                yield _sent(list(_blobs(*merged())))
                held = []
        if held:
            yield _sent(list(_blobs(*merged())))
        _forget()

    def sort(group: pa.Table) -> pa.Table:
        *columns, n = _unpacked(group, ["<u8"] * longest + ["<i8"])
        pair = mixed(columns[:2])
        spread = is_hot(pair)
        found = list(frequent_prefixes(columns, n, least, spread))
        on = np.flatnonzero(spread)
        if len(on):
            h, first, inverse = np.unique(pair[on], return_index=True, return_inverse=True)
            counts = np.bincount(inverse, n[on]).astype(np.int64)
            found += [([int(c[on[i]]) for c in columns[:2]], int(m)) for i, m in zip(first, counts, strict=True)]
        phrases = [np.array(p, np.uint64).view(np.int64) for p, _ in found]
        return pa.table({"phrase": pa.array(phrases, pa.list_(pa.int64())), "n": pa.array([m for _, m in found], pa.int64())})

    found = mapped(texts, send, _SENT).groupBy("part").applyInArrow(sort, "phrase array<long>, n long")
    return found.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring cut, n those of all words. Phrases that have a longer one
    around them as often as they occur at all are left out.
    """
    lang = F.coalesce("lang", F.lit("und")) if "lang" in docs.columns else F.lit("und")
    texts = docs.select(lang.alias("lang"), text_or_empty().cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    words = stored(word_counts(texts), "phrase-words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    if totals.count() <= MANY_LANGS:
        totals = F.broadcast(totals)
    often = stored(words.where(F.col("n") >= least).select("lang", "word", "n", F.xxhash64("lang", "word").alias("id")), "phrase-vocabulary")
    known = Bitmap(often, "id")
    pairs = stored(pair_counts(texts, known, max(1, -(-size // part_bytes)), least), "phrase-pairs")
    occurrences = pairs.agg(F.sum("n")).first()[0] or 0
    hot = pairs.where(F.col("n") > occurrences // HOT_PAIRS).select("pair").collect()  # HOT_PAIRS rows at most
    hot = np.array([r.pair for r in hot], np.int64).view(np.uint64)
    parts = max(1, -(-occurrences * 8 * (longest + 1) // part_bytes))
    phrases = stored(phrase_counts(texts, known, Bitmap(pairs, "pair"), hot, parts, least, longest), "phrases")
    released(pairs)
    return scored(phrases, often, totals, longest, top)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, longest: int, top: int) -> DataFrame:
    """Phrases by hashes (phrase, n) and words (lang, word, n, id) to the best of each language, as collocations has them."""
    length = F.size("phrase")
    counts = stored(phrases.unionByName(words.select(F.array("id").alias("phrase"), "n")), "phrase-counts")
    inside = phrases.where(length > 2).select("n", F.explode(F.array(F.slice("phrase", F.lit(1), length - 1), F.slice("phrase", F.lit(2), length - 1))).alias("phrase"))
    stay = phrases.join(inside.distinct(), ["phrase", "n"], "left_anti")
    cuts = stay.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1)))
    cuts = cuts.select("phrase", F.col("n").alias("a"), "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, length - F.col("k")).alias("right"))
    side = lambda name, n: counts.select(F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    first = words.select(F.col("id").alias("first"), "lang")
    cuts = cuts.join(first, F.element_at("phrase", 1) == F.col("first")).join(totals, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * wide("a", 14) * wide("total", 18), "down": wide("l", 18) * wide("r", 18)})
    cuts = cuts.withColumn("score", F.expr("up div down").cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut"))
    named = best.select("*", F.posexplode("phrase").alias("place", "id"))
    named = named.join(words.select("id", "word"), "id").groupBy("lang", "phrase", "a", "total", "cut").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    rows = named.select("lang", text.alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
