"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word is the sum of two hashed embeddings: of itself and of its first letters. Filters of several widths slide over the
words, each filter's largest response over the whole text (max pooling) goes to a logistic output. Training
uses at most `sample_rows` labelled documents of each class (those with the smallest hashes of their ids), whole texts, and of these none
of over `sample_bytes`, so what is collected has a bound; all documents are scored, of any length. The model has a
fixed size and goes to every task. For the filter, thresholds are calibrated for each language on scores out of fold: two more models are fitted on
a half of the training folds each and score the other half. A language with few labels is drawn to the threshold of all languages, and that one to 0.5
where labels are few altogether. Language is never an input of a score. The filter drops whatever reaches its threshold, empty texts too: fitted on a
handful of labels it can drop anything that looks like them.

Null and empty texts are scored like a text without words. Null labels and labels without a document are left out of training;
repeated labels count once. Without labels of both classes every score is 0.5 and the filter keeps everything. Rows that repeat
are scored each. Only doc_id, text (and lang for thresholds) are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.llm.common import Remembered, mapped, task_memory_released, text_or_empty
from trolley.llm.tokens import texts_in

BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
PREFIX = 5
#: Training goes on for so many steps at least, however few labels there are.
LEAST_STEPS = 72
STEPS = np.round(np.arange(0.5, 0.951, 0.05), 2)
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class WordIds(Remembered):
    """Word to its two hash buckets, packed into one number."""

    def value(self, word: bytes) -> int:
        whole = xxhash.xxh3_64_intdigest(word) % BUCKETS
        start = xxhash.xxh3_64_intdigest(word.decode("utf-8", "ignore")[:PREFIX].encode(), seed=1) % BUCKETS + BUCKETS
        return whole << 32 | start


_ids = WordIds()


def word_ids(text: bytes) -> np.ndarray:
    """(words, 2) bucket numbers of a text; A-Z lower-cased, ASCII punctuation dropped."""
    words = text.lower().translate(None, _STRIP).split()
    packed = np.fromiter(map(_ids.__getitem__, words), dtype=np.int64, count=len(words))
    return np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)


@dataclass
class Classifier:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    output: np.ndarray
    offset: float
    trained: bool = False  # on labels of both classes
    thresholds: dict[str | None, float] = field(default_factory=dict)
    pooled_threshold: float = 0.5

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Largest response of every filter over each document, two zero words after each."""
        lengths = np.array([max(1, len(d)) for d in docs])
        starts = np.concatenate([[0], np.cumsum(lengths + max(WIDTHS) - 1)])
        x = np.zeros((starts[-1] + max(WIDTHS), DIM), dtype=self.embedding.dtype)
        for d, s in zip(docs, starts, strict=False):
            if len(d):
                np.add(self.embedding[d[:, 0]], self.embedding[d[:, 1]], out=x[s : s + len(d)])
        n = starts[-1]
        spans = np.stack([starts[:-1], starts[:-1] + lengths], axis=1).ravel()
        out = []
        for w in WIDTHS:
            h = x[:n] @ self.filters[w][0]
            for j in range(1, w):
                h += x[j : n + j] @ self.filters[w][j]
            out.append(np.maximum.reduceat(h, spans, axis=0)[::2] + self.bias[w])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def score(self, docs: Iterable[np.ndarray], words_at_once: int = 20_000) -> np.ndarray:
        """Scores of documents, pooled together until they hold words_at_once words."""
        out, part, size = [np.zeros((0, self.output.size), np.float32)], [], 0
        for doc in docs:
            part.append(doc)
            size += len(doc) + max(WIDTHS)
            if size > words_at_once:
                out.append(self.pooled(part))
                part, size = [], 0
        if part:
            out.append(self.pooled(part))
        z = np.concatenate(out) @ self.output + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7, least_docs: int = 6) -> Classifier:
    """Adam on the logistic loss; a max-pooled filter passes its gradient to the words where it was largest.

    Buckets that fewer than least_docs documents use stay zero: they could only be learnt by heart.
    """
    rng = np.random.default_rng(seed)
    scale = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    model = Classifier(scale(2 * BUCKETS, DIM), {w: scale(w, DIM, FILTERS) for w in WIDTHS},
                       {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, scale(FILTERS * len(WIDTHS)), 0.0)
    model.embedding *= 0.3
    if not len(labels) or labels.min() == labels.max():
        model.output[:] = 0
        return model
    model.trained = True
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(docs) // batch)))
    spread = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2 * BUCKETS)
    usual = spread >= least_docs
    model.embedding[~usual] = 0
    parts = [model.embedding, *model.filters.values(), *model.bias.values(), model.output]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    seen, step = np.zeros(2 * BUCKETS, dtype=bool), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            grads = [np.zeros_like(p) for p in parts[1:]]
            rows, values, step = [], [], step + 1
            offset_grad = 0.0
            for some in _portions(chosen, docs):
                offset_grad += _gradients(model, [docs[i] for i in some], labels[some], len(chosen), grads, rows, values)
            model.offset -= rate * offset_grad
            touched, inverse = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.zeros(0, np.int64), None)
            sparse = np.zeros((len(touched), DIM), np.float32)
            if rows:
                np.add.at(sparse, inverse, np.concatenate(values))
                sparse[~usual[touched]] = 0
            seen[touched] = True
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for k, p in enumerate(parts):
                g, on = (sparse, touched) if k == 0 else (grads[k - 1], slice(None))
                first[k][on] = 0.9 * first[k][on] + 0.1 * g
                second[k][on] = 0.999 * second[k][on] + 0.001 * g * g
                p[on] -= rate * (first[k][on] / fix1) / (np.sqrt(second[k][on] / fix2) + 1e-8)
    model.embedding[~seen] = 0  # words that training never used say nothing
    return model


def _portions(chosen: np.ndarray, docs: list[np.ndarray], words_at_once: int = 100_000) -> Iterator[np.ndarray]:
    """The documents of a batch in portions of about so many words, so that long texts don't meet in memory."""
    size = np.cumsum([len(docs[i]) for i in chosen])
    cuts = np.flatnonzero(np.diff(size // words_at_once)) + 1
    yield from np.split(chosen, cuts)


def _gradients(model: Classifier, docs: list[np.ndarray], labels: np.ndarray, batch: int, grads: list[np.ndarray], rows: list, values: list) -> float:
    """Adds the gradients of some documents of a batch: to grads those of filters, biases and output, to rows and values those of word buckets; returns the offset's."""
    pad = max(WIDTHS) - 1
    lengths = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths + pad)])
    words = np.full((starts[-1] + pad, 2), -1, np.int64)
    for d, s in zip(docs, starts, strict=False):
        words[s : s + len(d)] = d
    x = model.embedding[words[:, 0]] + model.embedding[words[:, 1]]
    x[words[:, 0] < 0] = 0
    n, places, tops = starts[-1], [], []
    for w in WIDTHS:
        h = sum(x[j : n + j] @ model.filters[w][j] for j in range(w)) + model.bias[w]
        place = np.stack([s + h[s : s + k].argmax(axis=0) for s, k in zip(starts, lengths, strict=False)])
        places.append(place)
        tops.append(np.take_along_axis(h, place, axis=0))
    pooled = np.maximum(np.concatenate(tops, axis=1), 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.output + model.offset, -30, 30)))
    g = ((p - labels) / batch).astype(np.float32)
    grads[-1] += g @ pooled
    back = g[:, None] * model.output * (pooled > 0)
    for k, w in enumerate(WIDTHS):
        d = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads[len(WIDTHS) + k] += d.sum(axis=0)
        for j in range(w):
            where = places[k] + j
            grads[k][j] += np.einsum("dfk,df->kf", x[where], d)
            inside = words[where, 0] >= 0
            v = (d[:, :, None] * model.filters[w][j].T)[inside]
            rows += [words[where[inside], 0], words[where[inside], 1]]
            values += [v, v]
    return float(g.sum())


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the best F1, from 0.5 to 0.95; the lowest of equals."""
    f1 = [2 * ((scores >= t) & (labels == 1)).sum() / max(1, (scores >= t).sum() + labels.sum()) for t in STEPS]
    return float(STEPS[int(np.argmax(np.round(f1, 9)))])


def calibrated(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], few: int = 20) -> tuple[dict[str | None, float], float]:
    """(a threshold for each language, the one for languages without labels).

    The best threshold of a language counts by n / (n + few), n being the labels of its rarer class; the rest is the pooled threshold, and
    of that likewise 0.5. So few labels move a threshold little.
    """
    def shrunk(own: np.ndarray, base: float) -> float:
        n = min(labels[own].sum(), (1 - labels[own]).sum())
        return float(base + n / (n + few) * (best_threshold(scores[own], labels[own]) - base)) if n else base

    pooled = shrunk(np.ones(len(labels), bool), 0.5)
    return {lang: shrunk(np.array([x == lang for x in langs]), pooled) for lang in set(langs)}, pooled


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500, label: str = "toxic", calibrate: bool = False, sample_bytes: int = 1 << 20) -> Classifier:
    """Fits on at most sample_rows labelled documents of each class outside fold 0, none of over sample_bytes.

    With calibrate, thresholds come from scores out of fold: each half of the training folds is scored by a model that has seen the other half only.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen)  # at most 2 * sample_rows ids
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", fold(F.col("doc_id")).cast("int").alias("fold"), text_or_empty().cast("binary").alias("text"), lang.alias("lang")).where(F.octet_length("text") <= sample_bytes).join(chosen, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [word_ids(t).astype("<i4").tobytes() for t in texts_in(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), batch.column("lang"), batch.column("y"), batch.column("fold")],
                                             names=["doc_id", "ids", "lang", "y", "fold"])
        _ids.forget()

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("lang", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("fold", T.IntegerType())])
    rows = sorted(mapped(texts, read, schema).collect(), key=lambda r: (r.doc_id, bytes(r.ids)))
    samples = [np.frombuffer(r.ids, dtype="<i4").reshape(-1, 2) for r in rows]
    y = np.array([r.y for r in rows], dtype=np.float32)
    model = fit(samples, y)
    if calibrate and model.trained:
        half, unseen = np.array([r.fold % 2 for r in rows]), np.full(len(rows), np.nan)
        for h in (0, 1):
            other = fit([s for s, x in zip(samples, half, strict=True) if x != h], y[half != h])
            if other.trained:
                unseen[half == h] = other.score(s for s, x in zip(samples, half, strict=True) if x == h)
        on = np.isfinite(unseen)
        model.thresholds, model.pooled_threshold = calibrated(unseen[on], y[on], [r.lang for r, x in zip(rows, on, strict=True) if x])
    return model


def scores_of(batch: pa.RecordBatch, model: Classifier) -> np.ndarray:
    return model.score(map(word_ids, texts_in(batch)))


def _done() -> None:
    _ids.forget()
    task_memory_released()


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores_of(batch, shared.value))], names=["doc_id", "score"])
        _done()

    return mapped(docs.select("doc_id", text_or_empty().cast("binary").alias("text")), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500) -> DataFrame:
    """docs without those whose score reaches their language's threshold; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, calibrate=True))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
            limits = np.array([model.thresholds.get(x, model.pooled_threshold) if model.trained else 1.1 for x in langs])
            yield batch.filter(pa.array(scores_of(batch, model) < limits, pa.bool_()))
        _done()

    return mapped(docs, keep, docs.schema)
