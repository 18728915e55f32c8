"""Token counts by separator scan of flat, unindexed token files.

A token stream is cut into blocks of a fixed number of ids wherever that falls; nothing in it says where a document
begins. Each block is searched for the end-of-document id at once (numpy), and a prefix scan over the blocks'
summaries (ids before, separators before, last separator before) stitches the documents that cross blocks.

write_stream turns documents into such streams, one for each partition, with the names of the documents beside them. A block is a row of a
Parquet table: what a flat file holds at one place, in a form that tasks can share out.
Null text: no tokens, one separator. Ids after the last separator of a stream are a document too, with
complete=false. Null and repeated ids are documents of their own. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trolley.llm.common import mapped, stored, text_or_empty
from trolley.llm.tokens import texts_in, tokenizer_path, word_tokens

#: The separator in word_bpe_49k.json (its end-of-text token); texts that spell it out are encoded as ordinary text.
END_ID = 49407
BLOCK_IDS = 1 << 16


def write_stream(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """stream, block, payload (unsigned 16-bit ids), names (ids of the documents that end here), in the shared folder."""
    path = path or tokenizer_path()
    name = docs.schema["doc_id"]
    arrow = to_arrow_type(name.dataType)
    schema = T.StructType([T.StructField("stream", T.IntegerType()), T.StructField("block", T.LongType()),
                           T.StructField("payload", T.BinaryType()), T.StructField("names", T.ArrayType(name.dataType))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path, "<u2", True)
        stream, block, width = TaskContext.get().partitionId(), 0, 2 * block_ids
        end = np.array([end_id], dtype="<u2").tobytes()
        kept, names = bytearray(), []

        def row(payload: bytes, names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([stream], pa.int32()), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([names], pa.list_(arrow))],
                names=["stream", "block", "payload", "names"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts_in(batch)), strict=True):
                kept += ids
                kept += end
                while len(kept) > width:  # the separator of this document is still to come
                    yield row(bytes(kept[:width]), names)
                    del kept[:width]
                    block, names = block + 1, []
                names.append(doc_id)
        if kept:
            yield row(bytes(kept), names)

    return stored(mapped(docs.select("doc_id", text_or_empty().cast("binary").alias("text")), write, schema), "token-stream")


def scan_blocks(stream: DataFrame, end_id: int = END_ID) -> DataFrame:
    """stream, block, n_ids and the places of separators in each block."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(p.as_buffer(), dtype="<u2") for p in batch.column("payload")]
            at = [np.flatnonzero(x == end_id).astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("stream"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), pa.array(np.concatenate([*at, np.zeros(0, np.int32)])))],
                names=["stream", "block", "n_ids", "ends"])

    return stream.select("stream", "block", "payload").mapInArrow(scan, "stream int, block long, n_ids long, ends array<int>")


def count_tokens(stream: DataFrame, end_id: int = END_ID) -> DataFrame:
    """stream, ordinal, start, n_tokens, complete: one row for each document of each stream."""
    blocks = stored(scan_blocks(stream, end_id), "token-blocks")
    by_stream = Window.partitionBy("stream").orderBy("block")
    before = by_stream.rowsBetween(Window.unboundedPreceding, -1)
    n_ends = F.size("ends").cast("long")
    base = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    summary = blocks.select("stream", "block", "n_ids", n_ends.alias("n_ends"),
                            F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    summary = summary.withColumn("base", base).withColumn("first_ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    summary = summary.withColumn("last_at", F.col("base") + F.col("last_end"))
    summary = summary.withColumn("end_before", F.coalesce(F.max("last_at").over(before), F.lit(-1)))
    scanned = blocks.select("stream", "block", "ends").join(
        summary.select("stream", "block", "base", "first_ordinal", "end_before"), ["stream", "block"])
    ended = scanned.select("stream", "base", "first_ordinal", "end_before", "ends", F.posexplode("ends").alias("i", "end"))
    previous = F.when(F.col("i") == 0, F.col("end_before")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1))
    ended = ended.select("stream", (F.col("first_ordinal") + F.col("i")).alias("ordinal"), (previous + 1).alias("start"),
                         (F.col("base") + F.col("end") - previous - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    whole = summary.groupBy("stream").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("ordinal"), F.max("last_at").alias("last"))
    start = F.coalesce(F.col("last"), F.lit(-1)) + 1
    rest = whole.where(F.col("n") > start).select("stream", "ordinal", start.alias("start"), (F.col("n") - start).alias("n_tokens"), F.lit(False).alias("complete"))
    return ended.unionByName(rest)


def name_documents(stream: DataFrame, counted: DataFrame) -> DataFrame:
    """counted with the doc_id of each document, from the names written beside the stream."""
    by_stream = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = stream.select("stream", "block", "names").withColumn("first", F.coalesce(F.sum(F.size("names")).over(by_stream), F.lit(0)))
    named = named.select("stream", "first", F.posexplode("names").alias("i", "doc_id")).select(
        "stream", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return counted.join(named, ["stream", "ordinal"], "left").select("doc_id", *counted.columns)
