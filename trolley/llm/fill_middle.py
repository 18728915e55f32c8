"""Fill-in-middle: texts cut into prefix, middle and suffix, and put in another order around marks.

A text is cut between units: a run of ASCII letters, or one other code point. Cuts are found on the UTF-8 bytes, block by block of
`BLOCK` bytes; only multibyte characters are recorded, by position and excess bytes (the exception index), so a cut turns from bytes
into code points by one searchsorted and what is ASCII stays arithmetic. What is drawn for a document depends on its id alone.

Output of form psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle; plain: the text. Plain are empty texts, texts that hold a
mark, and those left as they are by the draw. No mark overlaps itself, so the first one found in an output is the one that was
put there, and restored() gives the text back.

Null text: empty. A null doc_id draws like an id without digits. Rows that repeat give rows that repeat. Texts of any length; an empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm.common import mapped, task_memory_released, text_or_empty
from trolley.llm.tokens import texts_in

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 20
#: By byte: whether it is an ASCII letter, and whether it begins a character.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])


@dataclass(frozen=True)
class Exceptions:
    """The multibyte characters of a text: byte position of each, and the excess bytes of those before it (one entry more, for all)."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = [np.flatnonzero(data[a : a + BLOCK] >= 0xC0) + a for a in range(0, len(data), BLOCK)]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        lead = data[at]
        return cls(at, np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))]))

    def code_points(self, byte: int) -> int:
        """How many code points come before a byte position between characters."""
        return byte - int(self.excess[np.searchsorted(self.at, byte)])

    def bytes(self, point: int) -> int:
        """The byte position of a code point: the inverse of code_points."""
        return point + int(self.excess[np.searchsorted(self.at - self.excess[:-1], point)])


class Units:
    """The units of a text, counted by block; only the blocks that are cut are searched for positions."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.upto = np.cumsum([0, *(int(np.count_nonzero(self._starts(a))) for a in range(0, len(data), BLOCK))])

    def _starts(self, a: int) -> np.ndarray:
        block = self.data[a : a + BLOCK]
        letter = _LETTER[block]
        follows = np.empty(len(block), bool)
        follows[1:] = letter[:-1]
        follows[:1] = a > 0 and _LETTER[self.data[a - 1]]
        return _BEGINS[block] & ~(letter & follows)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def byte(self, unit: int) -> int:
        """Where a unit begins, in bytes; for the number of all units the end of the text."""
        if unit >= len(self):
            return len(self.data)
        k = int(np.searchsorted(self.upto, unit, side="right")) - 1
        return k * BLOCK + int(np.flatnonzero(self._starts(k * BLOCK))[unit - int(self.upto[k])])


def drawn(doc_id: Column, salt: str = "1") -> list[Column]:
    """Four numbers of 32 bits for a document."""
    digits = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), digits).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(text: bytes, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    units = Units(data)
    n = len(units)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = (units.byte(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    index = Exceptions.of(data)
    p = index.code_points(a)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    first, second = (SUFFIX, suffix), (PREFIX, prefix)
    form = "spm" if h[3] % 100 < spm else "psm"
    if form == "psm":
        first, second = second, first
    return n, form, p, index.code_points(b) - p, b"".join([first[0].encode(), first[1], second[0].encode(), second[1], marks[2], middle])


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, salt: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row of docs; rate and spm are percentages."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, kind) for c, kind in (
        ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())))])
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), *[c.alias(f"h{k}") for k, c in enumerate(drawn(F.col("doc_id"), salt))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)), strict=True)
            made = [transform(text, h, rate, spm) for text, h in zip(texts_in(batch), draws, strict=True)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            output = pa.array([m[4] for m in made], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, output], names=schema.names)
        task_memory_released()

    return mapped(rows, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    def upto(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring(c, F.length(upto(c, mark)) + len(mark) + 1, F.length(c))

    psm = F.concat(upto(after(output, PREFIX), SUFFIX), after(output, MIDDLE), upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), after(output, MIDDLE), upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
