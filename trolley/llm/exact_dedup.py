"""Exact dedup with a log-structured merge index of digests, in DataFrame functions only.

Memtables are files of entries, sorted by digest, that one pass over the documents writes. They are dealt to runs; each run is flushed in turn, with one
entry for each digest (longest original text, then smallest doc_id; counts add up) and a filter on its digests beside it. FANOUT runs of a level
are compacted into one run of the next level. Compaction asks filters first: what no other run may hold is carried over as it is, and only the rest is shuffled and
merged. Likewise a batch that is looked up (`held`) reads only runs whose filter may hold some of its digests. Hits, entries whose
digest is held more than once, have their texts compared byte by byte with the text of the row that stays.

Nothing meets in one task because it is frequent: entries of a digest are summed before any shuffle, digests with a share of over
1 / HOT_DIGESTS of the rows (so HOT_DIGESTS of them at most) are joined by broadcast, and their texts are compared in portions of
that share, each with the text that stays beside it.

Null text counts as empty; all empty texts are one group. A null doc_id is an id like any other (it sorts before numbers). Of rows
that repeat an id and an original text exactly one is kept, which one is left open as they are alike. A text of any length is squeezed in one
task. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import SPACES, filter_bits, filter_blocks, in_filter, key_filter, noted, passing, scratch, stored, text_or_empty, thinned

FANOUT = 4
#: Rows of a memtable, of a run before it is flushed, and the most runs (beyond that, runs are larger).
MEMTABLE_ROWS, RUN_ROWS, MOST_RUNS = 1_000_000, 32_768, 64
HOT_DIGESTS = 10_000
PORTION = 1000
BEST = ("shorter", "doc_id", "text_hash", "row_no")


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, text)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(squeezed(text).cast("binary"), 256))


def entries(docs: DataFrame) -> DataFrame:
    """digest, best (what it is ranked by, and whose it is), group_size: one row for each row of docs."""
    t = text_or_empty()
    best = F.struct((-F.length(t)).alias("shorter"), "doc_id", F.xxhash64(t).alias("text_hash"), F.monotonically_increasing_id().alias("row_no"))
    return docs.select(digest_of(t).alias("digest"), best.alias("best"), F.lit(1).cast("long").alias("group_size"))


@dataclass(frozen=True)
class Run:
    """A table sorted by digest in each file, one entry for each digest, and the filter on its digests (blocks, bits)."""

    level: int
    table: DataFrame
    filter: tuple[DataFrame, int]


@dataclass
class Work:
    """What an index has done: runs flushed, compactions, rows that a filter let through to a merge, rows that it kept out, runs not read."""

    flushed: int = 0
    compacted: int = 0
    merged_rows: int = 0
    carried_rows: int = 0
    skipped_runs: int = 0


@dataclass(frozen=True)
class DigestIndex:
    runs: tuple[Run, ...] = ()
    bits: int | None = None  # of all filters; those of indexes without it are sized by their first run
    work: Work = field(default_factory=Work)

    def append(self, docs: DataFrame) -> DigestIndex:
        """The index with a batch of documents more; row numbers go on behind those of earlier batches."""
        return self.with_memtables(entries(docs))

    def with_memtables(self, rows: DataFrame) -> DigestIndex:
        """The index with one more run, flushed from entries; full levels are compacted."""
        bits = self.bits or filter_bits(rows.count())
        self.work.flushed += 1
        index = replace(self, bits=bits, runs=(*self.runs, flushed(merge([rows]), 0, bits)))
        level = 0
        while len(full := [r for r in index.runs if r.level == level]) >= FANOUT:
            self.work.compacted += 1
            index = replace(index, runs=(*[r for r in index.runs if r.level != level], index.compacted(full, level + 1)))
            level += 1
        return index

    def compacted(self, runs: list[Run], level: int) -> Run:
        """Some runs as one. Filters are asked first: entries that no other run may hold are carried over, only the others are shuffled."""
        maybe, sure = self.asked(runs)
        table = stored(merge(maybe).unionByName(reduce(DataFrame.unionByName, sure)), f"dedup-level{level}", "digest")
        return Run(level, table, (stored(either([r.filter for r in runs]), "dedup-filter"), self.bits))

    def asked(self, runs: list[Run]) -> tuple[list[DataFrame], list[DataFrame]]:
        """(entries that another one of the runs may hold too, entries that none does), by run."""
        maybe, sure = [], []
        for run in runs:
            others = either([r.filter for r in runs if r is not run])
            marked = stored(in_filter(run.table, (others, self.bits), "digest"), "dedup-asked")
            let = marked.where("may_be").count()
            self.work.merged_rows += let
            self.work.carried_rows += marked.count() - let
            maybe.append(marked.where("may_be").select("row.*"))
            sure.append(marked.where("NOT may_be").select("row.*"))
        return maybe, sure

    def groups(self) -> DataFrame | None:
        """digest, best, group_size over all runs: the last compaction, which leaves one row for each digest."""
        if len(self.runs) < 2:
            return self.runs[0].table if self.runs else None
        return self.compacted(list(self.runs), max(r.level for r in self.runs) + 1).table

    def repeated(self) -> DataFrame:
        """The groups of more than one row. Entries of one row that no other run may hold are left where they are."""
        if len(self.runs) < 2:
            return self.runs[0].table.where(F.col("group_size") > 1)
        maybe, sure = self.asked(list(self.runs))
        return reduce(DataFrame.unionByName, [merge(maybe), *sure]).where(F.col("group_size") > 1)

    def held(self, batch: DataFrame) -> DataFrame | None:
        """digest, best, group_size of the digests of batch (a column digest) that the index holds.

        A run's filter is asked first. Where nothing passes, its table is not read.
        """
        found = []
        for run in self.runs:
            maybe = stored(passing(batch.select("digest").distinct(), run.filter, "digest"), "dedup-asked")
            if maybe.isEmpty():
                self.work.skipped_runs += 1
            else:
                found.append(run.table.join(maybe, "digest", "left_semi"))
        return merge(found) if found else None


def flushed(df: DataFrame, level: int, bits: int) -> Run:
    """df as a run: each partition sorted by digest and written, and its filter."""
    table = stored(df, f"dedup-level{level}", "digest")
    return Run(level, table, (stored(filter_blocks(table, bits, "digest"), "dedup-filter"), bits))


def either(filters: list[tuple[DataFrame, int]]) -> DataFrame:
    """The blocks of a filter that lets through what one of some filters (of one size) lets through."""
    return reduce(DataFrame.unionByName, [f[0] for f in filters]).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def merge(tables: list[DataFrame]) -> DataFrame:
    """One entry for each digest of some runs: the best, and how many rows it stands for."""
    return reduce(DataFrame.unionByName, tables).groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def _named(best: str) -> list[Column]:
    return [F.col(best)[c].alias(c) for c in BEST]


def with_groups(rows: DataFrame, repeated: DataFrame, share: int) -> DataFrame:
    """rows (digest, best) with keep (the best of their digest) and group_size; a digest that isn't repeated keeps its only row.

    Rows that a filter on the repeated digests rules out aren't shuffled.
    """
    marked = in_filter(rows.select("digest", "best"), key_filter(repeated, "digest"), "digest")
    single = marked.where("NOT may_be").select("row.digest", "row.best", F.col("row.best").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    rows = marked.where("may_be").select("row.*")
    hot = repeated.where(F.col("group_size") > share)  # HOT_DIGESTS rows at most
    keep = lambda df, x: df.select(F.col("digest").alias(f"of{x}"), F.col("best").alias(f"keep{x}"), F.col("group_size").alias(f"size{x}"))
    part = rows.select("digest", "best").join(F.broadcast(keep(hot, 1)), F.col("digest") == F.col("of1"), "left")
    # rows of hot digests look for nothing: their key is null
    part = part.withColumn("key", F.when(F.col("of1").isNull(), F.col("digest")))
    rest = keep(repeated.join(F.broadcast(hot.select("digest")), "digest", "left_anti"), 2)
    there = part.where("key is not null").join(rest, F.col("key") == F.col("of2"), "left").select(
        "digest", "best", F.coalesce("keep2", "best").alias("keep"), F.coalesce("size2", F.lit(1)).alias("group_size"))
    return single.unionByName(there).unionByName(part.where("key is null").select("digest", "best", F.col("keep1").alias("keep"), F.col("size1").alias("group_size")))


def mismatches(docs: DataFrame, hits: DataFrame, share: int) -> DataFrame:
    """Byte verification: rows (digest, doc_id, text_hash, body) of hits (digest, best, keep, group_size) whose text isn't that of the row that stays."""
    t = text_or_empty()
    texts = docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("text_hash"))
    blocks = key_filter(hits.select("best.doc_id", "best.text_hash"), "doc_id", "text_hash")
    bodies = passing(texts, blocks, "doc_id", "text_hash").select("doc_id", "text_hash", squeezed(F.col("text")).alias("body"))
    bodies = stored(bodies.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256))), "dedup-bodies")
    kept = hits.groupBy("digest").agg(F.first("keep").alias("keep"), F.first("group_size").alias("n"))
    kept = stored(kept.select(F.col("digest").alias("of"), F.col("keep.doc_id").alias("of_id"), F.col("keep.text_hash").alias("of_hash"), F.floor(F.col("n") / share).alias("more")), "dedup-kept")
    # only the texts that stay, and those that a filter takes for them, go to this join
    own = passing(bodies.select("doc_id", "text_hash", "digest", "body"), key_filter(kept, "of_id", "of_hash"), "doc_id", "text_hash")
    stays = own.join(kept, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    stays = stays.groupBy("of", "more").agg(F.min("body").alias("kept_body")).select(
        "of", "kept_body", F.explode(F.sequence(F.lit(0), "more")).alias("of_portion"))
    large = kept.where("more > 0").select(F.col("of").alias("large"), "more")  # HOT_DIGESTS rows at most
    dealt = bodies.join(F.broadcast(large), F.col("digest") == F.col("large"), "left").withColumn(
        "portion", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("more") + 1), F.lit(0)))
    return dealt.join(stays, (F.col("digest") == F.col("of")) & (F.col("portion") == F.col("of_portion"))).where(
        F.col("body") != F.col("kept_body")).select("digest", "doc_id", "text_hash", "body")


def indexed(docs: DataFrame, run_rows: int = RUN_ROWS, most_runs: int = MOST_RUNS) -> tuple[DataFrame, DigestIndex]:
    """(entries of all rows, the index over them). Memtables are written once; runs of them are flushed one after the other."""
    rows = docs.count()
    runs = max(1, min(most_runs, -(-rows // run_rows)))
    memtables = entries(docs).withColumn("run", F.pmod(F.xxhash64("best.row_no"), F.lit(runs)).cast("int"))
    path = scratch(docs.sparkSession, "dedup-memtables")
    memtables.sortWithinPartitions("run", "digest").write.option("compression", "zstd").option("maxRecordsPerFile", MEMTABLE_ROWS).partitionBy("run").parquet(path)
    level0 = noted(docs.sparkSession.read.schema(memtables.schema).parquet(path), path)
    index = DigestIndex(bits=filter_bits(rows))
    for run in range(runs if rows else 0):
        index = index.with_memtables(level0.where(F.col("run") == run).drop("run"))
    return level0.drop("run"), index


def judged(docs: DataFrame) -> DataFrame:
    """digest, best, keep, group_size for each row of docs; kept rows are those whose best is keep."""
    level0, index = indexed(docs)
    repeated = index.repeated() if index.runs else level0.where("false")
    repeated = stored(repeated, "dedup-repeated")
    share = max(PORTION, level0.count() // HOT_DIGESTS)
    found = stored(with_groups(level0, repeated, share), "dedup-found")
    odd = stored(mismatches(docs, found.where(F.col("group_size") > 1), share), "dedup-mismatch")
    if odd.isEmpty():
        return found
    # different texts with one SHA-256: those are grouped by the texts themselves
    odd = odd.select(F.col("digest").alias("odd_digest"), F.col("doc_id").alias("odd_id"), F.col("text_hash").alias("odd_hash"), "body").distinct()
    at = (F.col("digest") == F.col("odd_digest")) & F.col("best.doc_id").eqNullSafe(F.col("odd_id")) & (F.col("best.text_hash") == F.col("odd_hash"))
    rows = found.join(odd, at, "left").drop("odd_digest", "odd_id", "odd_hash")
    own = rows.groupBy("digest", "body").agg(F.min("best").alias("own"), F.count(F.lit(1)).alias("own_size")).select(
        F.col("digest").alias("of"), F.col("body").alias("of_body"), "own", "own_size")
    return rows.join(own, (F.col("digest") == F.col("of")) & F.col("body").eqNullSafe(F.col("of_body"))).select(
        "digest", "best", F.col("own").alias("keep"), F.col("own_size").alias("group_size"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged(docs).select(
        "best.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("best.row_no") == F.col("keep.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each text; all columns stay.

    It is the row that exact_groups keeps; of rows that share its id and original text the one with the least hash of all columns. What
    goes is decided by id and text together, so a row never goes because another one has its id.
    """
    copies = judged(docs).where(F.col("group_size") > 1).groupBy(F.col("best.doc_id").alias("doc_id"), F.col("best.text_hash").alias("text_hash")).agg(
        F.max(F.col("best.row_no") == F.col("keep.row_no")).alias("stays"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies.where(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "text_hash", "stays"), "dedup-copies")
    return thinned(docs, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(text_or_empty())}, copies)
