"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words.  Its minimiser is the smallest hash
of the ``anchor``-word runs inside it; consecutive windows of a text with the
same minimiser form a super-k-mer, which travels to the minimiser's bucket as
one packed string of words.  In the bucket all windows are unpacked and
sorted, equal windows end up side by side, and each learns the smallest
document id that it starts in.  A word goes if a window over it also starts in
a document with a smaller id.

Plan (texts are shuffled once, and only texts with a repeated minimiser go on):

1. one pass over all texts: word count, digest, distinct minimisers;
2. minimisers seen in two or more documents (pre-aggregated, two numbers each)
   and, joined back, the texts that hold them;
3. super-k-mers of those texts, combined per batch, to buckets and sorted;
4. buckets' answers joined to the super-k-mers' places by a 128-bit key;
5. words removed.

A minimiser that very many documents share (a passage common to a third of
the corpus sits in as many different contexts) would fill one bucket, so its
windows travel one by one, spread by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.scratch import fresh, materialise
from veridock.plans.session import spread

WIDTH = 50
ANCHOR = 8
#: Documents sharing a minimiser above which its windows are spread.
HOT = 2000


def _minimisers(words: kernel.Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a range of texts: text, first word (counted in the range),
    number of windows, minimiser."""
    h = words.hashes()
    n_windows = np.maximum(words.counts() - width + 1, 0)
    if not n_windows.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    least = kernel.sliding_min(kernel.rolling(h, anchor), width - anchor + 1)
    first = words.word_at[:-1]
    text = np.repeat(np.arange(len(n_windows)), n_windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[text]
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(start)))
    return text[at], start[at], size, kernel.signed(value[at])


def _key(body: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(width: int, anchor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = kernel.utf8(b.column(2))
            n_words, digest, minis = [], [], []
            for lo, hi in kernel.slices(offsets):
                words = kernel.Words(buf, offsets, lo, hi)
                n_words.append(words.counts())
                data = words.buf.tobytes()
                at = words.text_at.tolist()
                digest += [hashlib.sha256(b" ".join(data[s:e].split())).hexdigest() for s, e in zip(at, at[1:])]
                text, _, _, value = _minimisers(words, width, anchor)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                minis += [np.unique(value[s:e]) for s, e in zip(cuts.tolist(), cuts[1:].tolist())]
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digest, pa.string()), pa.array(minis, pa.list_(pa.int64()))], ["id", "h", "n_words", "digest", "minis"])

    return run


def _super_kmers(b: pa.RecordBatch, width: int, anchor: int) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(row, place, minimiser, spread, packed words, windows) of a batch of
    (id, h, text, minis, hot) rows, only minimisers in ``minis``."""
    buf, offsets = kernel.utf8(b.column(2))
    wanted, hot = b.column(3), b.column(4)
    for lo, hi in kernel.slices(offsets):
        words = kernel.Words(buf, offsets, lo, hi)
        text, start, size, value = _minimisers(words, width, anchor)
        data = words.buf.tobytes()
        cuts = np.searchsorted(text, np.arange(hi - lo + 1)).tolist()
        for t in range(hi - lo):
            s, e = cuts[t], cuts[t + 1]
            if s == e:
                continue
            keep = np.isin(value[s:e], wanted[lo + t].values.to_numpy())
            if not keep.any():
                continue
            spread = np.isin(value[s:e], hot[lo + t].values.to_numpy())
            own = data[words.text_at[t] : words.text_at[t + 1]].split()
            base = int(words.word_at[t])
            for k in np.flatnonzero(keep).tolist():
                at, n, mini = int(start[s + k]) - base, int(size[s + k]), int(value[s + k])
                if spread[k]:
                    for w in range(at, at + n):
                        body = b" ".join(own[w : w + width])
                        yield lo + t, w, mini, _key(body)[0] & 0xFFF, body, 1
                else:
                    yield lo + t, at, mini, -1, b" ".join(own[at : at + n + width - 1]), n


def _pack(width: int, anchor: int):
    """Super-k-mers with the smallest and largest id of each in the batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            found: dict[tuple[int, int, bytes], list[int]] = {}
            size = 0

            def flush() -> pa.RecordBatch:
                keys = list(found)
                ends = list(found.values())
                return pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), pa.array([x[0] for x in ends], pa.int64()), pa.array([x[1] for x in ends], pa.int64())],
                    ["mini", "spread", "body", "lo", "hi"],
                )

            for row, _, mini, spread, body, _ in _super_kmers(b, width, anchor):
                doc = ids[row]
                have = found.get((mini, spread, body))
                if have is None:
                    found[mini, spread, body] = [doc, doc]
                    size += len(body)
                    if size > 32_000_000:
                        yield flush()
                        found, size = {}, 0
                elif doc < have[0]:
                    have[0] = doc
                elif doc > have[1]:
                    have[1] = doc
            if found:
                yield flush()

    return run


def _places(width: int, anchor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [(ids[row], hs[row], at, *_key(body)) for row, at, _, _, body, _ in _super_kmers(b, width, anchor)]
            for k in range(0, len(rows), 50_000):
                cols = list(zip(*rows[k : k + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "h", "at", "k1", "k2"])

    return run


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Runs of rows with the same bucket, over batch borders."""
    key, bodies, los, his = None, [], [], []
    for b in batches:
        for mini, spread, body, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (mini, spread) != key:
                if len(bodies) > 1 or (bodies and los[0] != his[0]):
                    yield bodies, los, his
                key, bodies, los, his = (mini, spread), [], [], []
            if bodies and body == bodies[-1]:  # rows are sorted by body too
                los[-1], his[-1] = min(los[-1], lo), max(his[-1], hi)
            else:
                bodies.append(body)
                los.append(lo)
                his.append(hi)
    if len(bodies) > 1 or (bodies and los[0] != his[0]):
        yield bodies, los, his


def _count(width: int):
    """First document of each window of each super-k-mer in sorted buckets; only
    super-k-mers that some document must give words up for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, list[int]]] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["k1", "k2", "firsts"])

        for bodies, los, his in _groups(batches):
            if min(los) == max(his):
                continue
            windows: list[tuple[bytes, int, int, int]] = []
            sizes = []
            for i, body in enumerate(bodies):
                ends = [-1, *(k for k, c in enumerate(body) if c == 0x20), len(body)]
                n = len(ends) - width
                sizes.append(n)
                windows += [(body[ends[k] + 1 : ends[k + width]], los[i], i, k) for k in range(n)]
            windows.sort()
            firsts = [[0] * n for n in sizes]
            last, first = None, 0
            for text, doc, i, k in windows:
                if text != last:
                    last, first = text, doc  # sorted by id within equal windows
                firsts[i][k] = first
            for body, hi, own in zip(bodies, his, firsts, strict=True):
                if min(own) < hi:
                    out.append((*_key(body), own))
            if len(out) >= 5000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return run


def _cut(width: int, with_text: bool):
    """Words left of each text; ``starts`` are the windows to remove."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digest, kept_text = [], [], []
            for text, starts in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                own = (text or "").encode().split()
                delta = np.zeros(len(own) + 1, np.int64)
                s = starts.values.to_numpy()
                np.add.at(delta, s, 1)
                np.add.at(delta, s + width, -1)
                gone = np.cumsum(delta[:-1]) > 0
                left = b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept_text.append(left.decode())
            arrays = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept_text, pa.string())] * with_text, ["id", "h", "n_removed", "digest", "kept_text"][: 4 + with_text])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, texts, cuts): per row id, h, n_words, digest; the texts that
    share a minimiser; and per (id, h) the word places of windows to remove.

    ``h`` is the text's hash, so rows that repeat an id with another text stay
    apart.  Rows with a null id take no part: nothing is removed from them, and
    they remove nothing.
    """
    rows = _rows(docs, id_col, text_col)
    profile = materialise(rows.mapInArrow(_profile(width, anchor), "id long, h long, n_words long, digest string, minis array<long>"), "profile")
    minis = profile.where(F.col("id").isNotNull()).select("id", "h", F.explode("minis").alias("mini"))
    shared = minis.groupBy("mini").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("mini", (F.col("n") > hot).alias("hot"))
    held = minis.join(shared, "mini").groupBy("id", "h").agg(F.collect_set("mini").alias("minis"), F.collect_set(F.when(F.col("hot"), F.col("mini"))).alias("hot"))
    texts = materialise(rows.where(F.col("id").isNotNull()).join(held, ["id", "h"]), "texts")
    texts = texts.select("id", "h", "text", "minis", "hot")

    packed = texts.mapInArrow(_pack(width, anchor), "mini long, spread int, body binary, lo long, hi long")
    buckets = packed.repartition("mini", "spread").sortWithinPartitions("mini", "spread", "body")
    answers = buckets.mapInArrow(_count(width), "k1 long, k2 long, firsts array<long>").dropDuplicates(["k1", "k2"])
    places = texts.mapInArrow(_places(width, anchor), "id long, h long, at long, k1 long, k2 long")
    found = places.join(answers, ["k1", "k2"]).where(F.array_min("firsts") < F.col("id"))
    starts = F.expr("transform(filter(sequence(0, size(firsts) - 1), i -> firsts[i] < id), i -> at + i)")
    cuts = found.select("id", "h", starts.alias("starts")).groupBy("id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return profile.drop("minis"), texts.select("id", "h", "text"), cuts


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    ``kept_sha256`` is the digest of the words left, joined by one space.  A
    null or empty text has no words; a text of fewer than ``width`` words loses
    none; rows with a null id keep all words.  Rows that repeat an id don't
    count as each other's copies.  One output row per input row; other columns
    aren't read.
    """
    profile, texts, cuts = repeated_windows(docs, id_col, text_col, width, anchor, hot)
    cut = texts.join(cuts, ["id", "h"]).mapInArrow(_cut(width, False), "id long, h long, n_removed long, digest string")
    cut = cut.dropDuplicates(["id", "h"]).withColumnRenamed("digest", "cut_digest")
    out = profile.join(cut, ["id", "h"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_digest", "digest").alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated words cut from the text column.

    A text that loses words is the words left, joined by one space (it can be
    empty); all other texts and all other columns stay as they are.
    """
    _, texts, cuts = repeated_windows(docs, id_col, text_col, width, anchor, hot)
    cut = texts.join(cuts, ["id", "h"]).mapInArrow(_cut(width, True), "id long, h long, n_removed long, digest string, kept_text string")
    cut_id, cut_h, cut_text = fresh(docs.columns, "cut_id", "cut_h", "cut_text")
    cut = cut.dropDuplicates(["id", "h"]).select(F.col("id").alias(cut_id), F.col("h").alias(cut_h), F.col("kept_text").alias(cut_text))
    on = (F.col(f"`{id_col}`").cast("long") == F.col(cut_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(cut_h))
    joined = docs.join(cut, on, "left")
    return joined.select(*[F.coalesce(cut_text, F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
