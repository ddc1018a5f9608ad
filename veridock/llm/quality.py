"""Quality classifier: supervised subword embeddings.

Every word (hash of its bytes; a word equal to the one before it has a bucket
of its own) and every character 3- and 4-gram of the text has a learned vector
in a hashed table.  A document is the mean of its word vectors plus the means
of its n-gram vectors; a softmax over two classes sits on top.  Vectors and
output layer are trained by plain stochastic gradient descent in numpy on a
bounded sample of labelled rows.  Because the output layer is linear, a
trained table collapses to one number per bucket, and scoring a text is a mean
of looked-up numbers over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.samples import labelled_texts
from veridock.plans.session import spread

BITS = 17
DIM = 8
_KINDS = 3  # words, 3-grams, 4-grams
_REPEAT = np.uint32(1)


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each byte n-gram that starts in ``buf``."""
    m = max(len(buf) - n + 1, 0)
    code = np.zeros(m, dtype=np.uint32)
    for k in range(n):
        code |= buf[k : k + m].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return code >> np.uint32(32 - BITS)


def _word_buckets(words: kernel.Words) -> np.ndarray:
    h = words.hashes()
    bucket = (h >> np.uint64(64 - BITS)).astype(np.uint32)
    if len(h):
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        first = words.word_at[:-1]
        same[first[first < len(h)]] = False
        bucket[same] = _REPEAT
    return bucket


def _ranges_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[s:e] for each range; 0 for an empty one."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=sums[1:])
    return sums[ends] - sums[starts]


def _gram_ranges(text_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts = text_at[:-1]
    ends = np.maximum(starts, text_at[1:] - n + 1)
    top = max(int(text_at[-1]) - n + 1, 0)
    return np.minimum(starts, top), np.minimum(ends, top)


@dataclass
class QualityModel:
    """Per-kind bucket scores (log-odds of label 1) and the bias."""

    tables: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        buf, offsets = kernel.utf8(column)
        out = np.empty(len(offsets) - 1)
        for lo, hi in kernel.slices(offsets):
            words = kernel.Words(buf, offsets, lo, hi)
            z = np.full(hi - lo, self.bias)
            n = words.counts()
            z += _ranges_sum(self.tables[0][_word_buckets(words)], words.word_at[:-1], words.word_at[1:]) / np.maximum(n, 1)
            for kind, size in ((1, 3), (2, 4)):
                s, e = _gram_ranges(words.text_at, size)
                z += _ranges_sum(self.tables[kind][_grams(words.buf, size)], s, e) / np.maximum(e - s, 1)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: distinct buckets (kinds one after another), weights, row starts."""
    index, weight, at = [], [], [0]
    for text in texts:
        buf, offsets = kernel.utf8(pa.array([text], pa.large_string()))
        words = kernel.Words(buf, offsets, 0, 1)
        parts = [_word_buckets(words), _grams(words.buf, 3), _grams(words.buf, 4)]
        for kind, part in enumerate(parts):
            b, c = np.unique(part, return_counts=True)
            index.append(b.astype(np.int64) + (kind << BITS))
            weight.append((c / max(len(part), 1)).astype(np.float32))
            at.append(at[-1] + len(b))
    empty = np.zeros(0, np.int64)
    return np.concatenate(index or [empty]), np.concatenate(weight or [empty.astype(np.float32)]), np.array(at[::_KINDS])


def train(samples: list[tuple[str, int]], epochs: int | None = None, rate: float = 20.0, batch: int = 32, seed: int = 7) -> QualityModel:
    """SGD on the softmax loss; small samples get more epochs.  Without rows of both labels the model is the
    smoothed share of label 1 for every text."""
    labels = np.array([y for _, y in samples], dtype=np.int64)
    n = len(labels)
    prior = (labels.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if n == 0 or labels.min() == labels.max():
        return QualityModel(np.zeros((_KINDS, 1 << BITS), np.float32), bias)
    epochs = epochs or int(np.clip(18_000 // n, 5, 40))
    index, weight, at = _features([t for t, _ in samples])
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((_KINDS << BITS, DIM)) * 0.01).astype(np.float32)
    output = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    intercept = np.array([0.0, bias], dtype=np.float32)
    steps, step = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            lr = rate * (1 - step / steps)
            step += 1
            rows = order[k : k + batch]
            sizes = at[rows + 1] - at[rows]
            total = int(sizes.sum())
            own = np.repeat(np.arange(len(rows)), sizes)
            where = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[rows], sizes)
            f, w = index[where], weight[where]
            mean = np.zeros((len(rows), DIM), np.float32)
            full = sizes > 0
            if total:
                mean[full] = np.add.reduceat(vectors[f] * w[:, None], (np.cumsum(sizes) - sizes)[full])
            logits = mean @ output + intercept
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = p @ output.T
            output -= (lr * 0.02 / len(rows)) * (mean.T @ p)
            intercept -= (lr * 0.002 / len(rows)) * p.sum(0)
            touched, place = np.unique(f, return_inverse=True)
            for d in range(DIM):
                vectors[touched, d] -= (lr / len(rows)) * np.bincount(place, w * back[own, d], len(touched)).astype(np.float32)
    diff = output[:, 1] - output[:, 0]
    return QualityModel((vectors @ diff).reshape(_KINDS, 1 << BITS), float(intercept[1] - intercept[0]))


def fit(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, max_chars: int = 20_000) -> QualityModel:
    """Train on at most ``max_rows`` labelled texts (of longer ones ``max_chars``
    characters from everywhere in them); ``where`` restricts the labels' ``id``."""
    return train(labelled_texts(docs, labels, id_col, text_col, label_col, where, max_rows, max_chars))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of label 1 for every row's whole text.

    One output row per input row, repeated rows and null ids included.  A null
    or empty text has no features and gets the probability of the bias alone.
    Other columns of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 3 * 2**17 floats

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], ["id", "score"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with all their columns,
    in one pass and without a shuffle.  Null and empty texts are judged by the
    bias, which is the labels' share of good rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
