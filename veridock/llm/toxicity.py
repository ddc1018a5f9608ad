"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on labelled text: two *toxic* ones
from toxic texts and an *ordinary* one from ordinary texts.  A text is cut into
windows of ``WINDOW`` words.  Each window is compressed with every dictionary;
the bytes that a toxic dictionary saves against the ordinary one are its
distance.

*Dictionaries.*  A byte 6-gram of a word is telling if it is much more frequent
in toxic than in ordinary text (G-test; each distinct context of word before,
word and word after counts once, so copies of a text are no evidence).  Passages
are chosen greedily, each for the telling 6-grams it adds.  Telling grams that
ordinary text hardly has go to the *certain* dictionary, the others to the
*likely* one.  The ordinary dictionary holds the ordinary words with the
6-grams of toxic passages that are not telling.  Words that no sample has seen
are matched by what they share with a passage.

*Thresholds.*  How often windows of toxic and of ordinary training texts reach
each distance gives a log-likelihood ratio for each distance and dictionary
(made monotone).  A text's value is the largest sum of these over a run of
windows, so that a short toxic passage of a long text isn't averaged away;
the limit between toxic and ordinary values is calibrated on training texts.

Windows stand between two carriers that all dictionaries hold: zstandard stores
tiny inputs raw and doesn't search their last eight bytes.  Matches have six
bytes at least, hence a window without a 6-gram of a toxic passage has no match
there, its distance is at most 0, and it needn't be compressed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.langid import normalise
from veridock.llm.samples import labelled_texts
from veridock.plans.session import spread

WINDOW = 2
GRAM = 6
_BITS = 22
_BINS = 11  # distances below the first that counts, ten steps from there on
_HEAD = bytes(np.random.default_rng(3).integers(1, 31, 16, dtype=np.uint8).tolist()) + b" "
_TAIL = bytes(np.random.default_rng(4).integers(1, 31, 16, dtype=np.uint8).tolist())
_SLICE = 4_000_000


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=GRAM, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
    )
    dictionary = zstandard.ZstdCompressionDict(content + _HEAD[:-1] + b"|" + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def _lengths(tool: zstandard.ZstdCompressor, data: bytes, size: np.ndarray) -> np.ndarray:
    segments = np.stack([np.cumsum(size) - size, size], 1).astype(np.uint64).tobytes()
    out = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=0)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes buf[start:start + size] of all ranges, one after another."""
    return buf[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def _grams(buf: np.ndarray) -> np.ndarray:
    """Code of the 6-gram that starts at each byte."""
    n = max(len(buf) - GRAM + 1, 0)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | buf[k : k + n]
    return kernel.mix(code) >> np.uint64(64 - _BITS)


@dataclass
class _Text:
    """Normalised words of a range of texts, each between single blanks."""

    buf: np.ndarray  # a blank, then every word with a blank behind it
    at: np.ndarray  # word k is buf[at[k] + 1 : at[k + 1]]; its blanks are at both ends
    word_at: np.ndarray  # words of text t are word_at[t] .. word_at[t + 1] - 1

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> _Text:
        at = offsets[lo : hi + 1] - offsets[lo]
        words = kernel.Words(normalise(buf[offsets[lo] : offsets[hi]]), at, 0, hi - lo)
        size = words.end - words.start
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]) + 1 if len(ends) else 1, 0x20, np.uint8)
        inner = np.ones(len(out), bool)
        inner[np.append(0, ends)] = False
        out[inner] = _gather(words.buf, words.start, size)
        return cls(out, np.append(0, ends), words.word_at)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word and last word + 1 of all windows, and first and last window + 1 of each text."""
        n = np.diff(self.word_at)
        count = -(-n // WINDOW)
        ends = np.cumsum(count)
        own = np.repeat(np.arange(len(n)), count)
        first = self.word_at[own] + (np.arange(len(own)) - (ends - count)[own]) * WINDOW
        return first, np.minimum(first + WINDOW, self.word_at[own + 1]), ends - count, ends


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: tuple[bytes, bytes]  # certain, likely
    first: int = 4  # smallest distance that counts
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(2 * _BINS - 1))  # none, certain by distance, likely by distance
    threshold: float = 10.0
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.first, self.ratios, self.threshold

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _ready(self) -> tuple:
        if not self._tools:
            known = np.zeros(1 << _BITS, bool)
            for part in self.toxic:
                known[_grams(np.frombuffer(part, np.uint8))] = True
            self._tools[:] = [known, *map(_compressor, (self.ordinary, *self.toxic))]
        return self._tools

    def distances(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each toxic dictionary saves on windows (with carriers) of the given sizes."""
        _, ordinary, certain, likely = self._ready()
        base = _lengths(ordinary, data, size)
        return base - _lengths(certain, data, size), base - _lengths(likely, data, size)

    def hits(self, text: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a positive distance: number, both distances; and the windows of each text."""
        first, last, begin, end = text.windows()
        shared = np.append(0, np.cumsum(self._ready()[0][_grams(text.buf)]))
        s, e = text.at[first], text.at[last] + 1
        top = len(shared) - 1
        close = np.flatnonzero(shared[np.clip(e - GRAM + 1, 0, top)] > shared[np.minimum(s, top)])
        s, e = s[close], e[close]
        inner = e - s - 1  # the blank in front is the head's
        size = inner + len(_HEAD) + len(_TAIL)
        data = np.empty(int(size.sum()), np.uint8)
        at = np.cumsum(size) - size
        for part, shift in ((_HEAD, 0), (_TAIL, None)):
            place = at if shift == 0 else at + len(_HEAD) + inner
            data[(place[:, None] + np.arange(len(part))).ravel()] = np.tile(np.frombuffer(part, np.uint8), len(at))
        own = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
        data[np.repeat(at + len(_HEAD), inner) + own] = _gather(text.buf, s + 1, inner)
        certain, likely = self.distances(data.tobytes(), size) if len(close) else (close, close)
        good = (certain > 0) | (likely > 0)
        return close[good], certain[good], likely[good], begin, end

    def largest(self, number: np.ndarray, certain: np.ndarray, likely: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Largest sum of ratios over a run of windows of each text, at least 0."""
        out = np.zeros(len(begin))
        step = _bins(certain, likely, self.first)
        keep = step > 0
        number, value = number[keep].tolist(), self.ratios[step[keep]].tolist()
        none = float(self.ratios[0])
        text = (np.searchsorted(begin, number, side="right") - 1).tolist() if number else []
        last, place, run = -1, 0, 0.0
        for t, w, x in zip(text, number, value, strict=True):
            run = x + (max(run + none * (w - place - 1), 0.0) if t == last else 0.0)
            if run > out[t]:
                out[t] = run
            last, place, run = t, w, max(run, 0.0)
        return out

    def values(self, column: pa.Array) -> np.ndarray:
        buf, offsets = kernel.utf8(column)
        out = np.zeros(len(offsets) - 1)
        if any(self.toxic):
            for lo, hi in kernel.slices(offsets, _SLICE):
                text = _Text.of(buf, offsets, lo, hi)
                if len(text.at) > 1:
                    out[lo:hi] = self.largest(*self.hits(text))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(self.threshold - self.values(column)))


def _bins(certain: np.ndarray, likely: np.ndarray, first: int) -> np.ndarray:
    """0 below the first distance that counts, else the step of the certain dictionary, else that of the likely one."""
    step = lambda x: np.clip(x - first + 1, 0, _BINS - 1)
    a, b = step(certain), step(likely)
    return np.where(a > 0, a, np.where(b > 0, b + _BINS - 1, 0))


def _word_counts(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words and the number of distinct contexts that each stands in."""
    buf, offsets = kernel.utf8(pa.array(texts, pa.large_string()))
    codes, hashes, words = [], [], {}
    for lo, hi in kernel.slices(offsets):
        text = _Text.of(buf, offsets, lo, hi)
        if len(text.at) < 2:
            continue
        h = kernel.range_hashes(text.buf, text.at[:-1] + 1, text.at[1:])
        before, after = np.append(np.uint64(0), h[:-1]), np.append(h[1:], np.uint64(0))
        full = np.diff(text.word_at) > 0
        before[text.word_at[:-1][full]] = 0
        after[text.word_at[1:][full] - 1] = 0
        code, first = np.unique(kernel.mix(before * np.uint64(3) ^ kernel.mix(h.copy()) ^ after * np.uint64(5)), return_index=True)
        codes.append(code)
        hashes.append(h[first])
        data = text.buf.tobytes()
        distinct, place = np.unique(h, return_index=True)
        for key, k in zip(distinct.tolist(), place.tolist(), strict=True):
            words.setdefault(key, data[text.at[k] : text.at[k + 1] + 1])
    if not codes:
        return [], np.zeros(0, np.int64)
    _, first = np.unique(np.concatenate(codes), return_index=True)
    distinct, times = np.unique(np.concatenate(hashes)[first], return_counts=True)
    return [words[key] for key in distinct.tolist()], times


def _gram_sets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each word (with its blanks), and the words' bounds among them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    code = _grams(np.frombuffer(b"".join(words), np.uint8))
    n = np.maximum(size - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(words)), n)
    key = np.unique(owner.astype(np.uint64) << np.uint64(_BITS) | _gather(code, start, n)) if len(owner) else np.zeros(0, np.uint64)
    owner = (key >> np.uint64(_BITS)).astype(np.int64)
    return (key & np.uint64((1 << _BITS) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(words) + 1))


def _passages(words: list[bytes], grams: np.ndarray, at: np.ndarray, weight: np.ndarray, least: float, allowed: np.ndarray | None = None) -> bytes:
    """Words chosen one by one for the weight of the grams they add (more than
    ``least``), the heaviest last, where matches are cheapest."""
    weight = weight.copy()
    sums = np.append(0, np.cumsum(weight[grams]))
    total = sums[at[1:]] - sums[at[:-1]]
    good = total > least if allowed is None else (total > least) & allowed
    heap = [(-total[i], words[i], i) for i in np.flatnonzero(good).tolist()]
    heapq.heapify(heap)
    out: list[bytes] = []
    while heap:
        _, word, i = heapq.heappop(heap)
        own = grams[at[i] : at[i + 1]]
        now = float(weight[own].sum())
        if now <= least:
            continue
        if heap and (-now, word, i) > heap[0]:
            heapq.heappush(heap, (-now, word, i))
            continue
        out.append(word)
        weight[own] = 0
    return b"".join(reversed(out))


def _telling(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> tuple[np.ndarray, np.ndarray]:
    """G statistic of grams more frequent in toxic text (0 for others), and how many times as frequent they are."""
    share = all1 / (all1 + all0)
    part = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(e, 1e-9)), 0.0)
    expected = (n1 + n0) * share
    g = 2 * (part(n1, expected) + part(n0, (n1 + n0) * (1 - share)))
    return np.where(n1 > expected, g, 0.0), (n1 / all1) / ((n0 + 0.5) / all0)


def _monotone(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log ratios that don't fall with the distance (pooled where they would)."""
    blocks: list[list[float]] = []
    for a, b in zip(toxic.tolist(), ordinary.tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            a2, b2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k]
    return np.log(np.array([a / b for a, b, k in blocks for _ in range(int(k))]))


def train(samples: list[tuple[str, int]], least: float = 60.0, certain: float = 30.0, shared: float = 3.0, false_cost: float = 2.0) -> ToxicityModel:
    """Dictionaries, ratios and threshold.

    ``least`` is the G statistic from which a gram is telling, ``certain`` the
    number of times more frequent it must be for the certain dictionary,
    ``shared`` the number below which a gram of a toxic passage belongs to the
    ordinary dictionary, ``false_cost`` what a false alarm rate costs against
    the recall when the threshold is chosen.  Without texts of both labels or
    without telling grams every text scores just above 0.
    """
    bad, good = [t for t, y in samples if y], [t for t, y in samples if not y]
    toxic_words, toxic_times = _word_counts(bad)
    plain_words, plain_times = _word_counts(good)
    model = ToxicityModel(b"", (b"", b""))
    if not toxic_words or not plain_words:
        return model
    toxic_grams, toxic_at = _gram_sets(toxic_words)
    plain_grams, plain_at = _gram_sets(plain_words)
    n1 = np.bincount(toxic_grams, np.repeat(toxic_times, np.diff(toxic_at)), 1 << _BITS)
    n0 = np.bincount(plain_grams, np.repeat(plain_times, np.diff(plain_at)), 1 << _BITS)
    g, lift = _telling(n1, n0, int(toxic_times.sum()), int(plain_times.sum()))
    pick = lambda test: _passages(toxic_words, toxic_grams, toxic_at, np.where((g > least) & test, g, 0.0), least)
    toxic = pick(lift >= certain), pick((lift < certain) & (lift > shared))
    if not any(toxic):
        return model
    held = np.zeros(1 << _BITS, bool)
    for part in toxic:
        held[_grams(np.frombuffer(part, np.uint8))] = True
    telling = np.append(0, np.cumsum(((g > least) & (lift > shared))[plain_grams]))
    clean = telling[plain_at[1:]] == telling[plain_at[:-1]]
    ordinary = _passages(plain_words, plain_grams, plain_at, np.where(held & (lift < shared), n0, 0.0), 20, clean)
    model = ToxicityModel(ordinary, toxic)
    buf, offsets = kernel.utf8(pa.array([t for t, _ in samples], pa.large_string()))
    label = np.array([y for _, y in samples], bool)
    found = [(lo, hi, model.hits(_Text.of(buf, offsets, lo, hi))) for lo, hi in kernel.slices(offsets, _SLICE)]
    best = None
    for first in (3, 4, 5):
        counts = np.zeros((2, 2 * _BINS - 1))
        for lo, hi, (number, a, b, begin, end) in found:
            own = label[lo:hi][np.searchsorted(begin, number, side="right") - 1] if len(number) else np.zeros(0, bool)
            step = _bins(a, b, first)
            for y in (0, 1):
                counts[y] += np.bincount(step[own == y], minlength=2 * _BINS - 1)
                counts[y, 0] += (end - begin)[label[lo:hi] == y].sum() - (own == y).sum()
        toxic_rate, plain_rate = (counts[1] + 0.2) / (counts[1] + 0.2).sum(), (counts[0] + 1.8) / (counts[0] + 1.8).sum()
        steps = [_monotone(toxic_rate[s], plain_rate[s]) for s in (slice(1, _BINS), slice(_BINS, None))]
        ratios = np.concatenate([[min(np.log(toxic_rate[0] / plain_rate[0]), 0.0)], *steps])
        trial = ToxicityModel(ordinary, toxic, first, ratios)
        value = np.concatenate([trial.largest(*h) for _, _, h in found])
        up, down = np.sort(value[label]), np.sort(value[~label])
        limits = np.unique(value[value > 0])
        limits = np.append((limits[1:] + limits[:-1]) / 2, limits[-1:] + 1)
        gain = (1 - np.searchsorted(up, limits) / len(up)) - false_cost * (1 - np.searchsorted(down, limits) / len(down))
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            trial.threshold = float(limits[k])
            best = gain[k], trial
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 5000, max_chars: int = 20_000) -> ToxicityModel:
    """Train on at most ``max_rows`` labelled texts (of longer ones ``max_chars``
    characters from everywhere in them); ``where`` restricts the labels' ``id``."""
    return train(labelled_texts(docs, labels, id_col, text_col, label_col, where, max_rows, max_chars))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row's whole text; a null or empty text has no window
    and scores as a text without any toxic window.  One output row per input
    row; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three dictionaries of a few KB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], ["id", "score"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
