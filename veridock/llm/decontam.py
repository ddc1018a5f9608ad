"""Benchmark decontamination: weighted Jaccard of item-sized windows.

Words are runs of letters and digits (bytes above 127 count as letters), in
lower case.  A window of an item's number of words (fewer where it hangs over
an end of the text) holds a passage of the item if the weighted Jaccard
similarity of their sets of ``SHINGLE``-word shingles reaches the threshold.

A shingle weighs 1 / (1 + log(number of items that hold it)), counted once over
all items whatever block they are in, and 1 if no item holds it.

Such a window holds shingles of the item that weigh at least the threshold
times the item's whole weight.  All places of the items' shingles in a text
are looked up, running sums over them show where a window can hold that much,
and every window there is compared.  So no window is missed.  Weights are
whole numbers (``UNIT`` is 1), which makes all sums exact.

SimHash fingerprints take no part in this: at similarity 0.6 those of 128 bits
scatter around 29 differing bits, and a radius of 39, the least that misses
fewer than 1 % of the pairs, lets a quarter of all random pairs meet in a block
(figures in the README).  The search above misses nothing and costs less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.plans.session import spread

SHINGLE = 2
ANCHOR = 4
UNIT = 1 << 32
#: Places of item shingles looked at together (and those of one item length before them).
PLACES = 4_000_000
#: Items indexed and broadcast at once; the documents are read once for each block of items.
ITEM_BLOCK = 50_000
#: Bytes of a block of more than one item.
ITEM_BLOCK_BYTES = 16_000_000

_PLAIN = kernel.LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _words(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> kernel.Words:
    at = offsets[lo : hi + 1] - offsets[lo]
    return kernel.Words(_PLAIN[buf[offsets[lo] : offsets[hi]]], at, 0, hi - lo)


def _weights(codes: np.ndarray, shared: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(shared):
        return np.full(len(codes), UNIT)
    at = np.minimum(np.searchsorted(shared, codes), len(shared) - 1)
    return np.where(shared[at] == codes, weights[at], UNIT)


@dataclass
class ItemIndex:
    ids: np.ndarray
    n_words: np.ndarray
    shingles: list[np.ndarray]  # distinct, sorted
    known: np.ndarray  # all distinct shingles, sorted
    weights: np.ndarray  # of known, in UNITs
    shared: tuple[np.ndarray, np.ndarray]  # shingles of several items, sorted, and their weights
    whole: np.ndarray  # weight of all shingles of an item
    holders: tuple[np.ndarray, np.ndarray]  # CSR starts by known, items of at least ANCHOR words
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # number of words: codes, CSR starts, items

    def weight(self, codes: np.ndarray) -> np.ndarray:
        return _weights(codes, *self.shared)

    def candidates(self, codes: np.ndarray, places: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item, s, t): starts s..t of the windows that can reach ``threshold``.

        ``places`` are those of ``codes`` that are shingles, ``first`` is the
        first place of the text that each lies in.
        """
        at, items = self.holders
        if not len(items) or not len(places):
            return
        spot = np.minimum(np.searchsorted(self.known, codes[places]), len(self.known) - 1)
        hit = self.known[spot] == codes[places]
        places, first, spot = places[hit], first[hit], spot[hit]
        many = at[spot + 1] - at[spot]
        sums = np.cumsum(many)
        length = self.n_words - SHINGLE + 1
        longest = int(length[items].max())
        need = threshold * self.whole * (1 - 1e-9)
        begin = 0
        while begin < len(places):
            end = max(int(np.searchsorted(sums, PLACES + (sums[begin - 1] if begin else 0), side="right")), begin + 1)
            early = int(np.searchsorted(places, places[begin] - longest + 1))
            n = many[early:end]
            own = np.repeat(np.arange(early, end), n)
            item = items[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[spot[early:end]], n)].astype(np.int64)
            key = item * len(codes) + places[own]
            order = np.argsort(key, kind="stable")
            key, own, item = key[order], own[order], item[order]
            weight = np.append(0, np.cumsum(self.weights[spot[own]]))
            left = np.searchsorted(key, item * len(codes) + np.maximum(places[own] - length[item] + 1, first[own]))
            good = np.flatnonzero((weight[1:] - weight[left] >= need[item]) & (own >= begin))
            item, s, t, text = item[good], places[own[good]] - length[item[good]] + 1, places[own[good]], first[own[good]]
            new = np.ones(len(good), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (s[1:] > t[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(good)) - 1
            yield from zip(item[heads].tolist(), s[heads].tolist(), t[tails[: len(heads)]].tolist(), strict=True)
            begin = end

    def best_window(self, codes: np.ndarray, first: int, last: int, item: int, s: int, t: int) -> tuple[float, int]:
        """Similarity and minus the place of the best window that starts at s..t (the
        first of equals) in a text with the shingles codes[first:last]."""
        length = int(self.n_words[item]) - SHINGLE + 1
        low = max(s, first)
        distinct, code = np.unique(codes[low : min(t + length, last)], return_inverse=True)
        weight, code = self.weight(distinct).tolist(), code.tolist()
        shared = np.isin(distinct, self.shingles[item], assume_unique=True).tolist()
        times = [0] * len(distinct)
        whole, own, common = int(self.whole[item]), 0, 0
        found = (-1.0, 0)
        for start in range(s, t + 1):
            if start > s and start > first:
                c = code[start - 1 - low]
                times[c] -= 1
                if not times[c]:
                    own -= weight[c]
                    common -= weight[c] * shared[c]
            for k in range(low if start == s else max(start + length - 1, low), min(start + length, last)):
                c = code[k - low]
                if not times[c]:
                    own += weight[c]
                    common += weight[c] * shared[c]
                times[c] += 1
            found = max(found, (common / (own + whole - common), -max(start, first)))
        return found


def _shingle_codes(h: np.ndarray, n: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Code of the shingle that starts at each word; the last word of a text of one
    word is a shingle of its own (other last words start none)."""
    codes = np.zeros(len(h), np.uint64)
    if len(h) > SHINGLE - 1:
        codes[: len(h) - SHINGLE + 1] = kernel.rolling(h, SHINGLE)
    for t in np.flatnonzero((n > 0) & (n < SHINGLE)):
        codes[word_at[t]] = kernel.rolling(h[word_at[t] : word_at[t + 1]], int(n[t]), salt=17)[0]
    return codes


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word hashes; and of the texts with words: place, first and last word, distinct shingles."""
    buf, offsets = kernel.utf8(column)
    words = _words(buf, offsets, 0, len(column))
    h, n = words.hashes(), words.counts()
    codes = _shingle_codes(h, n, words.word_at)
    used = np.flatnonzero(n > 0)
    first, last = words.word_at[:-1][used], words.word_at[1:][used]
    return h, used, first, last, [np.unique(codes[a:b]) for a, b in zip(first, np.maximum(last - SHINGLE + 1, first + 1), strict=True)]


def _shared(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several items hold, sorted, and their weights."""
    order = np.argsort(codes)
    codes, times = codes[order], times[order]
    many = times > 1
    return codes[many], np.rint(UNIT / (1 + np.log(times[many]))).astype(np.int64)


def build_index(items: list[tuple[int, str]], shared: tuple[np.ndarray, np.ndarray] | None = None) -> ItemIndex | None:
    """Index of (id, text) items; items without words are left out.  ``shared``
    are the weights from all items, if these are only a block of them."""
    h, used, first, last, shingles = _shingles(pa.array([t or "" for _, t in items], pa.large_string()))
    if not len(used):
        return None
    known, times = np.unique(np.concatenate(shingles), return_counts=True)
    shared = _shared(known, times) if shared is None else shared
    weights = _weights(known, *shared)
    size = last - first
    short = {}
    for width in range(1, ANCHOR):
        own = np.flatnonzero(size == width)
        if len(own):
            code = kernel.rolling(h, width)[first[own]]
            order = np.argsort(code, kind="stable")
            distinct, at = np.unique(code[order], return_index=True)
            short[width] = (distinct, np.append(at, len(code)), own[order])
    spots = [np.searchsorted(known, x) for x in shingles]
    whole = np.array([weights[x].sum() for x in spots])
    spot = np.concatenate([x if w >= ANCHOR else x[:0] for x, w in zip(spots, size, strict=True)])
    item = np.concatenate([np.full(len(x) if w >= ANCHOR else 0, k, np.int32) for k, (x, w) in enumerate(zip(spots, size, strict=True))])
    order = np.argsort(spot, kind="stable")
    holders = (np.searchsorted(spot[order], np.arange(len(known) + 1)), item[order])
    return ItemIndex(np.array([items[i][0] for i in used]), size.astype(np.int64), shingles, known, weights, shared, whole, holders, short)


def match(index: ItemIndex, column: pa.Array, threshold: float) -> list[tuple[int, int, int, float]]:
    """(row, item id, first word, similarity): the best window of each row and item."""
    buf, offsets = kernel.utf8(column)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for lo, hi in kernel.slices(offsets):
        words = _words(buf, offsets, lo, hi)
        if not words.n:
            continue
        h, n = words.hashes(), words.counts()
        text = words.text_of()

        def keep(t: int, i: int, likeness: float, place: int, lo=lo, words=words) -> None:
            key, found = (lo + t, i), (likeness, place + int(words.word_at[t]))
            if key not in best or found > best[key]:
                best[key] = found

        for width, (distinct, at, item) in index.short.items():
            codes = kernel.rolling(h, width)
            spot = np.minimum(np.searchsorted(distinct, codes), len(distinct) - 1)
            hit = np.flatnonzero(distinct[spot] == codes)
            for p in hit[text[hit] == text[hit + width - 1]].tolist():
                for i in item[at[spot[p]] : at[spot[p] + 1]].tolist():
                    keep(int(text[p]), i, 1.0, -p)
        codes = _shingle_codes(h, n, words.word_at)
        places = np.flatnonzero(text[: len(h) - SHINGLE + 1] == text[SHINGLE - 1 :])
        for i, s, t in index.candidates(codes, places, words.word_at[text[places]], threshold):
            own = int(text[t])
            likeness, place = index.best_window(codes, int(words.word_at[own]), int(words.word_at[own + 1]) - SHINGLE + 1, i, s, t)
            if likeness >= threshold:
                keep(own, i, likeness, place)
    return [(row, int(index.ids[i]), -place, likeness) for (row, i), (likeness, place) in sorted(best.items())]


def distinct_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()


def shared_weights(items: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the shingles that several items hold.

    Counted on the executors, each batch of items added up first; 16 bytes for
    each shingle that more than one item holds come to the driver, and go to
    the executors once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(b.column(0))[-1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times.astype(np.int64))], ["code", "times"])

    counted = distinct_items(items, id_col, text_col).select("text").mapInArrow(run, "code long, times long")
    table = counted.groupBy("code").agg(F.sum("times").alias("times")).where("times > 1").toArrow()
    return _shared(table["code"].to_numpy().view(np.uint64), table["times"].to_numpy())


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded number and bytes (one item at least)."""
    block, size = [], 0
    for r in distinct_items(items, id_col, text_col).orderBy("id", "text").toLocalIterator():
        if block and (len(block) >= ITEM_BLOCK or size + len(r.text) > ITEM_BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.id, r.text))
        size += len(r.text)
    if block:
        yield block


def finders(items: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[Callable[[pa.Array], list[tuple[int, int, int, float]]]]:
    """``match`` for each block of items, to be called on the executors."""
    sc = items.sparkSession.sparkContext
    weights = shared_weights(items, id_col, text_col)
    everywhere = sc.broadcast(weights)
    for block in item_blocks(items, id_col, text_col):
        index = build_index(block, weights)
        if index is not None:
            part = sc.broadcast(replace(index, shared=()))  # bounded by ITEM_BLOCK
            yield lambda column, part=part: match(replace(part.value, shared=everywhere.value), column, threshold)


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6) -> DataFrame:
    """(id, item_id, first_word, similarity): for each document and item the most
    similar window at or above ``threshold`` (the first one of equals).

    A null text or one without words matches nothing, nor does a null item or
    one without words.  Items of fewer than ``ANCHOR`` words must occur whole.
    Repeated documents give repeated rows; of items that repeat an id and text
    one counts.  Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()))
    schema = "id long, item long, first_word long, similarity double"
    parts = []
    for find in finders(items, item_id, item_text, threshold):

        def run(batches: Iterable[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = find(b.column(1))
                if found:
                    row, item, first, likeness = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(likeness)], ["id", "item", "first_word", "similarity"])

        parts.append(rows.mapInArrow(run, schema))
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Rows of ``docs`` that hold no passage of any item, with all their columns.

    One filter for each block of items, chained without a shuffle; rows with a
    null or empty text stay.
    """
    at = docs.columns.index(text_col)
    out = docs
    for find in finders(items, item_id, item_text, threshold):

        def run(batches: Iterable[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, *_ in find(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
