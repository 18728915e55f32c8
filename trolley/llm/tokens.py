"""Token ids of whole texts, word by word.

In the vocabularies used here no token crosses white space, so the ids of a text are those of its words in
turn. Each worker remembers the ids of words it has seen, up to a number of bytes.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Encodes texts (bytes); ids come as little-endian unsigned integers of the given width, joined."""

    limit = 80 << 20
    entry = 190  # bytes that an entry takes besides its word and ids
    chunk_bytes = 2 << 20
    #: ASCII marks between an ASCII letter or digit and white space are cut off either way; apart, the word is more often a known one.
    mark = re.compile(rb"(?<=[a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=[ \n])")

    def __init__(self, path: str, dtype: str = "<u4", special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 20, 20)  # many small objects and no cycles: look for those less often
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype(dtype)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        new = list(words - self.known.keys())
        if self.held > self.limit:
            self.known.clear()
            self.held, new = 0, list(words)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            ids = [e.ids for e in found]
            joined = np.fromiter(chain.from_iterable(ids), dtype=self.dtype).tobytes()
            ends = (np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize).tolist()
            self.held += len(part) * self.entry + sum(map(len, part)) + len(joined)
            self.known.update((w, joined[a:b]) for w, a, b in zip(part, ends, ends[1:], strict=False))

    def words(self, text: bytes) -> list[bytes]:
        if b"<|" not in text:  # letters of special tokens keep their case
            text = self.mark.sub(rb" \1", text.lower())
        return text.split()

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text in turn; words are learnt for many texts at once."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(self.words(text))
            size += len(text)
            if size > self.chunk_bytes:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[bytes]]) -> Iterator[bytes]:
        self.learn(set().union(*held))
        known = self.known
        for words in held:
            yield b"".join([known[w] for w in words])


_made: dict[tuple, WordTokens] = {}


def word_tokens(path: str, dtype: str = "<u4", special_as_text: bool = False) -> WordTokens:
    """One encoder for each Python worker."""
    key = (path, dtype, special_as_text)
    if key not in _made:
        _made[key] = WordTokens(*key)
    return _made[key]


def texts_in(batch, column: str = "text") -> Iterator[bytes]:
    """The texts of an Arrow batch one by one, null as empty."""
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""
