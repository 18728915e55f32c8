"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become pieces of at most `limit` tokens (only longer ones are cut). Bins are filled one after another: the
longest length left is seeded, and bitset subset-sum dynamic programming over the lengths left finds the
fullest feasible combination, which is removed. Equal bins are made at once: a combination is repeated until one of its
lengths runs out. The plan needs only the number of pieces of each length, so it holds at most a few rows for
each of `limit` lengths however many pieces there are; pieces then take the places of their length by rank.

Null text: empty, which is one end token. Null and repeated ids are rows of their own. An empty table packs into
nothing. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm.common import mapped, ranked, stored, task_memory_released, text_or_empty
from trolley.llm.tokens import texts_in, tokenizer_path, word_tokens

END_ID = 1


def cut_pieces(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's token ids followed by the end id."""
    path = path or tokenizer_path()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, encoded in enumerate(encoder.encode_all(texts_in(batch))):
                ids = memoryview(encoded + end)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        task_memory_released()

    return mapped(docs.select("doc_id", text_or_empty().cast("binary").alias("text")), cut, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill the room best; lengths are sorted, longest first, and longer ones are preferred."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            new = (reach | reach << n) & mask
            if new == reach:
                break
            steps.append((n, reach))
            reach = new
            if reach & full:
                break
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + 1
            at -= n
    return used


def plan_bins(counts: dict[int, int], limit: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, repeats, first sequence, first offset) of each stretch of a length's pieces.

    The stretch holds `copies` pieces for each of `repeats` equal sequences: its r-th piece goes to
    sequence first + r % repeats, at first offset + (r // repeats) * length.
    """
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    taken = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while order:
        seed = order[0]
        left[seed] -= 1
        used = fullest(order, left, limit - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        repeats = min(left[n] // k for n, k in used.items())
        offset = 0
        for n in sorted(used, reverse=True):
            out.append((n, taken[n], repeats, sequence, offset))
            taken[n] += used[n] * repeats
            left[n] -= used[n] * repeats
            offset += n * used[n]
        sequence += repeats
        order = [n for n in order if left[n]]
    return out


def pack(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """The pieces of docs with sequence_id and offset; each sequence is gapless from 0 and at most `limit` long."""
    pieces = stored(cut_pieces(docs, limit, path), "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    plan = sorted(plan_bins(counts, limit))
    columns = [np.array(c, dtype=np.int64) for c in zip(*plan, strict=True)] or [np.zeros(1, dtype=np.int64)] * 5
    length, first, repeats, sequence, offset = columns
    keys = (length << 44) + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, rank in batches:
            n, rank = n.to_numpy(), rank.to_numpy()
            i = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            r = rank - first[i]
            yield pd.DataFrame({"sequence_id": sequence[i] + r % repeats[i], "offset": offset[i] + r // repeats[i] * n})

    numbered = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], max(counts.values(), default=0))
    return numbered.withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
