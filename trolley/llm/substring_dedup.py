"""Substring dedup by hashing lines, and the sentences inside lines.

Units are lines; with unit="passage" also the sentences of lines of more than one, for passages that are set within a line; with unit="sentence" the pieces
of lines between sentence marks alone (a line without such marks is one unit). A unit is normalised (lower case, white space runs as one space), its
128-bit digest is grouped globally, and the occurrence that ranks first (smallest doc_id, then hash of the text, then place) is kept. All later
occurrences are removed, as runs of neighbouring repeated units of one document. A repeated line is reported as a line; its sentences aren't reported
again, and a run of sentences stays within its line. `least_words` is an option to leave runs of fewer words in place; it is 1, none, unless given. Offsets are code points of
the original text, end exclusive; keep_doc_id and keep_start say where the kept occurrence of a run's first unit is.

A task sends on one row for each unit that it has seen, with the number of its occurrences; all but the first of these are repeats
whatever the other tasks hold, and they go to the groups in turn, so a unit that is everywhere is no hot key. Blobs are sent only to groups
that have some share in them: there are never more of them than units.

doc_id is an integer (other types raise a TypeError); null ids rank first. A document is an id and a text: rows that repeat both are one
document, rows that repeat an id with other texts are apart. Null and empty texts have no units. A text of any length is read in one task. Empty
tables give no rows. Other columns are ignored by repeated_runs and kept by remove_repeats, which adds `removed` (in place of a column of that name).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm.common import mapped, stored, text_or_empty

LINE, SENTENCE = re.compile(r"[^\n]+"), re.compile(r"[^\n.!?]+[.!?]*")
#: Levels of units.
LEVELS = ("line", "sentence")
LEAST_WORDS = 1
#: Units with a share of over 1 / HOT_UNITS of the runs are looked up by broadcast, HOT_UNITS rows at most.
HOT_UNITS = 10_000
_NULL = np.iinfo(np.int64).min
#: An occurrence of a unit: digest, document (id and hash of its text), place among its units, offsets, words, level, line; of a first one how many there are.
ROW = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8"), ("text_hash", "<i8"), ("unit", "<i4"), ("start", "<i8"), ("end", "<i8"), ("words", "<i4"), ("level", "<i4"), ("line", "<i4"), ("count", "<i8")])
FOUND = "kind int, h1 long, h2 long, doc_id long, text_hash long, unit int, start long, end long, words int, level int, line int, count long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def units_of(doc_id: int, text_hash: int, text: str, unit: str) -> list[tuple]:
    out = []

    def add(m: re.Match, level: int, no: int, line: int, at: int = 0) -> bool:
        words = m.group().lower().split()
        if words:
            h = xxhash.xxh3_128_intdigest(" ".join(words).encode())
            start = at + m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((_signed(h >> 64), _signed(h & (1 << 64) - 1), doc_id, text_hash, no, start, at + m.end(), len(words), level, line, 1))
        return bool(words)

    if unit == "sentence":
        for m in SENTENCE.finditer(text):
            add(m, 1, len(out), 0)
        return out
    lines = sentences = 0
    for m in LINE.finditer(text):
        known = add(m, 0, lines, lines)
        parts = list(SENTENCE.finditer(m.group())) if known and unit == "passage" else []
        if sum(not p.group().isspace() for p in parts) > 1:
            for p in parts:
                sentences += add(p, 1, sentences, lines, m.start())
            sentences += 1  # no run goes on in another line
        lines += known
    return out


def split_firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrences with the sums of counts, repeats); equal rows count once."""
    rows = rows[np.lexsort((rows["start"], rows["text_hash"], rows["doc"], rows["h2"], rows["h1"]))]
    if not len(rows):
        return rows, rows
    same = (rows["h1"][1:] == rows["h1"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
    again = np.append(False, same & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["text_hash"][1:] == rows["text_hash"][:-1]) & (rows["start"][1:] == rows["start"][:-1]))
    first = np.append(True, ~same)
    firsts = rows[first]
    firsts["count"] = np.add.reduceat(np.where(again, 0, rows["count"]), np.flatnonzero(first))
    return firsts, rows[~first & ~again]


def found_table(kind: int, rows: np.ndarray) -> pa.Table:
    columns = {"kind": pa.array(np.full(len(rows), kind, np.int32)), "doc_id": pa.array(rows["doc"], mask=rows["doc"] == _NULL)}
    columns |= {c: pa.array(np.ascontiguousarray(rows[c])) for c in ("h1", "h2", "text_hash", "unit", "start", "end", "words", "level", "line", "count")}
    return pa.table(columns).select([c.split(" ")[0] for c in FOUND.split(", ")])


def repeated_units(docs: DataFrame, unit: str = "line", part_bytes: int = 24 << 20, flush: int = 200_000) -> DataFrame:
    """Stored rows of two kinds: 0 occurrences that are not the first one, 1 first occurrences of units that have others, with their number."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    sent = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("firsts", "repeats"))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0

        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal turn
            firsts, repeats = split_firsts(np.array(rows, dtype=ROW))
            part = firsts["h1"] % parts
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            blobs = [(int(k), x.tobytes(), b"") for k, x in zip(own, np.split(firsts[order], starts[1:]), strict=False)]
            if len(repeats):
                turn += 1
                blobs.append((turn % parts, b"", repeats.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), *(pa.array([b[k] for b in blobs], pa.binary()) for k in (1, 2))], names=sent.names)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                turn += turn == 0 and (text_hash % parts)
                rows += units_of(_NULL if doc_id is None else doc_id, text_hash, text.as_py(), unit)
                if len(rows) > flush:
                    yield flushed(rows)
                    rows = []
        if rows:
            yield flushed(rows)

    def grouped(group: pa.Table) -> pa.Table:
        blobs = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), ROW) for x in group.column(c)])
        firsts, repeats = split_firsts(blobs("firsts"))
        return pa.concat_tables([found_table(0, repeats), found_table(0, blobs("repeats")), found_table(1, firsts[firsts["count"] > 1])])

    return stored(mapped(texts, hashed, sent).groupBy("part").applyInArrow(grouped, FOUND), "repeated-units")


def _runs(docs: DataFrame, least_words: int, unit: str) -> DataFrame:
    """doc_id, text_hash, start, end, units, words, level, keep_doc_id, keep_start."""
    found = repeated_units(docs, unit)
    document = ["doc_id", "text_hash"]
    # one shuffle serves the repeated rows and the windows
    units = found.where("kind = 0").repartition(*document).dropDuplicates([*document, "level", "unit"])
    if unit == "passage":
        whole = F.max(F.col("level") == 0).over(Window.partitionBy(*document, "line"))
        units = units.withColumn("whole", whole).where((F.col("level") == 0) | ~F.col("whole"))
    island = F.col("unit") - F.row_number().over(Window.partitionBy(*document, "level").orderBy("unit"))
    runs = units.withColumn("island", island).groupBy(*document, "level", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("units"), F.sum("words").alias("words"),
        F.min_by(F.struct("h1", "h2"), "unit").alias("first"))
    runs = stored(runs.where(F.col("words") >= least_words), "repeated-runs")
    kept = found.where("kind = 1").select("h1", "h2", F.col("doc_id").alias("keep_doc_id"), F.col("start").alias("keep_start"), "count")
    share = max(1000, found.count() // HOT_UNITS)
    hot = kept.where(F.col("count") > share).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("keep_doc_id").alias("hot_doc"), F.col("keep_start").alias("hot_start"), F.lit(True).alias("is_hot"))
    near = runs.join(F.broadcast(hot), (F.col("first.h1") == F.col("g1")) & (F.col("first.h2") == F.col("g2")), "left")
    columns = [*document, "start", "end", "units", "words", "level"]
    rare = near.where("is_hot is null").join(kept.where(F.col("count") <= share), (F.col("first.h1") == F.col("h1")) & (F.col("first.h2") == F.col("h2")))
    return rare.select(*columns, "keep_doc_id", "keep_start").unionByName(
        near.where("is_hot").select(*columns, F.col("hot_doc").alias("keep_doc_id"), F.col("hot_start").alias("keep_start")))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, unit: str = "line") -> DataFrame:
    """doc_id, start, end, units, words, keep_doc_id, keep_start, unit: the runs to remove, and where the kept occurrence of their first unit is."""
    runs = _runs(docs, least_words, unit)
    return runs.select("doc_id", "start", "end", "units", "words", "keep_doc_id", "keep_start", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("unit"))


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, unit: str = "line") -> DataFrame:
    """docs with text without its repeated runs, and removed (array of start and end in the original text).

    Rows that repeat an id and a text are cut alike.
    """
    runs = _runs(docs, least_words, unit).groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    others = [c for c in docs.columns if c != "removed"]
    packed = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_or_empty()).alias("hash"))
    joined = packed.join(runs, F.col("doc").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    n, text = F.size("cut"), F.col("row.text")

    def after(i: Column) -> Column:
        """Where the i-th kept piece begins."""
        return F.when(i > 0, F.get("cut", F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0)

    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        text, (after(i) + 1).cast("int"), (F.when(i < n, F.get("cut", i)["start"]).otherwise(F.length(text)) - after(i)).cast("int")))
    left = F.when(n > 0, F.array_join(pieces, "")).otherwise(text)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(*[left.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in others], F.coalesce("cut", none).alias("removed"))
