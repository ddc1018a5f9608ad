"""MinHash near-dedup with odd sketches.

A document's set is its distinct ``shingle``-word runs (lower-cased A-Z).
Documents whose sets have Jaccard similarity of at least 75 % are linked, and
linked documents form components.

1. Each text gets ``BANDS * ROWS`` MinHash values, the band keys made of them,
   the digest of its set, and an *odd sketch*: each MinHash value flips one bit
   of a parity bitmap, so that the bits in which two bitmaps differ count the
   samples in which two sets differ.  Similar sets differ in few bits, where
   the count is most precise.
2. Texts with the same set are one class.
3. Classes that share a band are candidates.  In each band the smallest class
   leads; all others are first compared with it, so a band of n classes gives
   n - 1 pairs.  Pairs whose sketches rule the similarity out are dropped; the
   others are confirmed on their full sets of words.
4. Bands whose classes are not one component yet go on by prefix filtering: two
   sets can only be similar enough if they share one of the rarest shingles of
   each (as many as they may lack, and one).  Rare shingles are few where texts
   merely share a template, so a band of very many unlinked classes dissolves
   into small groups.  In each group of a shingle the classes outside the
   largest component lead in turn, ``LEADERS`` in a round, and are compared
   with those of other components, until every group is one component.

Misses: a pair at exactly the threshold shares none of 40 bands of 5 rows with
probability 2e-5, less for similar pairs; nothing is capped or sampled.  Pairs
within a component aren't compared, so the number of links isn't known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.llm import kernel
from veridock.llm.scratch import fresh, materialise, release
from veridock.plans.components import connected_components
from veridock.plans.session import spread

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8  # 512 bits
_BITS = 64 * SKETCH_WORDS
#: Largest sketch difference of pairs that are still confirmed: the mean at similarity 0.5,
#: more than 8 standard deviations from what similarity 0.75 gives.
SKETCH_LIMIT = int(_BITS / 2 * (1 - (1 - 2 / _BITS) ** (2 * SAMPLES * 0.5)))
#: Classes of a group that are compared with the others in one round.
LEADERS = 16
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 2**63, SAMPLES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 2**63, SAMPLES, dtype=np.int64).astype(np.uint64)
_BIT_SALTS = _rng.integers(1, 2**63, SAMPLES, dtype=np.int64).astype(np.uint64)


def _shingles(words: kernel.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the text's bounds among them."""
    h = words.hashes()
    n = words.counts()
    size = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), dtype=np.uint64)
    full = n >= width
    runs = kernel.rolling(h, width)
    text = np.repeat(np.arange(len(n)), np.where(full, size, 0))
    place = np.arange(len(text)) - np.repeat(np.cumsum(np.where(full, size, 0)) - np.where(full, size, 0), np.where(full, size, 0))
    out[at[text] + place] = runs[words.word_at[text] + place]
    for t in np.flatnonzero((n > 0) & ~full):
        a, b = words.word_at[t], words.word_at[t + 1]
        out[at[t]] = kernel.rolling(h[a:b], b - a, salt=17)[0]
    return out, at


def _profile(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = kernel.utf8(b.column(2))
            n = len(offsets) - 1
            size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_WORDS), np.uint64)
            for lo, hi in kernel.slices(offsets):
                words = kernel.Words(buf, offsets, lo, hi, lower=True)
                values, at = _shingles(words, width)
                for t in range(hi - lo):
                    own = np.unique(values[at[t] : at[t + 1]])
                    size[lo + t] = len(own)
                    d1[lo + t] = own.sum(dtype=np.uint64)
                    d2[lo + t] = kernel.mix(own * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                full = np.flatnonzero(np.diff(at) > 0)
                if not len(full):
                    continue
                mins = np.empty((SAMPLES, len(full)), np.uint64)
                for k in range(SAMPLES):
                    mins[k] = np.minimum.reduceat(values * _FACTORS[k] + _SHIFTS[k], at[:-1][full])
                for band in range(BANDS):
                    acc = np.full(len(full), band + 1, np.uint64)
                    for r in range(ROWS):
                        acc = kernel.mix(acc ^ mins[band * ROWS + r])
                    bands[lo + full, band] = acc
                bit = kernel.mix(mins ^ _BIT_SALTS[:, None]) % np.uint64(_BITS)
                for k in range(SAMPLES):
                    sketches[lo + full, (bit[k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[k] & np.uint64(63))
            band_lists = pa.FixedSizeListArray.from_arrays(pa.array(kernel.signed(bands).ravel()), BANDS).cast(pa.list_(pa.int64()))
            sketch_lists = pa.FixedSizeListArray.from_arrays(pa.array(kernel.signed(sketches).ravel()), SKETCH_WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(kernel.signed(d1)), pa.array(kernel.signed(d2)), band_lists, sketch_lists], ["id", "h", "n", "d1", "d2", "bands", "sketch"])

    return run


def _set_of(text: bytes, width: int) -> set:
    words = text.translate(bytes(kernel.LOWER.tolist())).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _confirm(width: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, salt, b, text) sorted so that the leader's own row (null b) comes
    first; yields the pairs that are similar enough on full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, set()
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b is None:
                    leader, own = (a, salt), _set_of(text.encode(), width)
                    continue
                if leader != (a, salt):
                    raise RuntimeError("a leader's text is missing")
                other = _set_of(text.encode(), width)
                common = len(own & other)
                if 100 * common >= percent * (len(own) + len(other) - common):
                    a_out.append(a)
                    b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, group: int = 500) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough.  ``texts`` has each class's
    text by ``node``.  A leader's text is sent once for each ``group`` of its
    partners, so that a leader of very many is spread over many tasks."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    partner = pairs.join(groups.hint("merge"), "a").join(texts.hint("merge").withColumnRenamed("node", "b"), "b")
    partner = partner.select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), "b", "text")
    lead = groups.join(texts.hint("merge").withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    rows = partner.unionByName(lead).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(width, percent), "a long, b long")


def _difference(left: str, right: str) -> Column:
    return F.expr(f"aggregate(zip_with({left}, {right}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the wanted similarity."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes & (_difference("s_a", "s_b") <= SKETCH_LIMIT)).select("a", "b")


def _sets(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, shingle): distinct shingle hashes of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = kernel.utf8(b.column(1))
            for lo, hi in kernel.slices(offsets):
                values, at = _shingles(kernel.Words(buf, offsets, lo, hi, lower=True), width)
                own = [np.unique(values[at[t] : at[t + 1]]) for t in range(hi - lo)]
                node = b.column(0)[lo:hi].take(pa.array(np.repeat(np.arange(hi - lo), [len(x) for x in own])))
                yield pa.RecordBatch.from_arrays([node, pa.array(kernel.signed(np.concatenate(own)))], ["node", "shingle"])

    return run


def _prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, node): the rarest shingles of each text, as many as it may lack and
    one, of those that several texts hold.  Any order of shingles would do, as
    long as it is the same for all."""
    held = materialise(texts.select("node", "text").mapInArrow(_sets(width), "node long, shingle long"), "shingles")
    times = held.groupBy("shingle").agg(F.count("*").alias("times"))
    ranked = held.join(times.hint("merge"), "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("own"))
    least = F.ceil(F.size("own") * percent / 100)
    prefix = ranked.select("node", F.explode(F.slice("own", F.lit(1), (F.size("own") - least + 1).cast("int"))).alias("x"))
    return materialise(prefix.where("x.times > 1").select(F.col("x.shingle").alias("key"), "node"), "prefixes")


def _placed(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, part): classes of the groups that aren't one component."""
    placed = groups.join(parts.hint("merge").select("node", F.col("component").alias("part")), "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
    open_keys = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    return placed.join(open_keys.hint("merge"), "key", "left_semi")


def _leaders(placed: DataFrame) -> DataFrame:
    """(key, node, part) of up to ``LEADERS`` classes outside the largest component of each group."""
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "part"))["part"].alias("largest"))
    outside = placed.join(largest.hint("merge"), "key").where("part != largest").select("key", "node", "part")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    return outside.withColumn("rank", rank).where(F.col("rank") <= LEADERS).drop("rank")


def _components(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(profile, classes): id, h, n, d1, d2 of every row; and d1, d2, n, node, component
    and own (the smallest id and h) of each class."""
    profile = materialise(spread(rows).mapInArrow(_profile(width), "id long, h long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"), "minhash")
    members = profile.where(F.col("id").isNotNull() & (F.col("n") > 0))
    grouped = members.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "h")).alias("own"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, by the table that is written
    banded = classes.select("node", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead")
    crowded = materialise(banded.join(leads.hint("merge"), "band"), "bands")

    stars = crowded.where("node > lead").groupBy(F.col("node").alias("b")).agg(F.collect_set("lead").alias("leads"))
    stars = materialise(_plausible(stars.select(F.explode("leads").alias("a"), "b"), classes, percent), "pairs")
    own = classes.join(crowded.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.col("own.id").alias("id"), F.col("own.h").alias("h_own"))
    # the hash is compared by xor so that the join, and the aggregate after it, stay keyed by id alone
    texts = rows.join(own.hint("merge"), "id").where(F.expr("h ^ h_own = 0")).groupBy("id", "node").agg(F.max("text").alias("text"))
    texts = materialise(texts.select("node", "text"), "texts")

    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(confirmed(first, texts, width, percent), "links")
    parts = connected_components(links, materialise)
    open_pairs = stars.join(first.hint("merge"), ["a", "b"], "left_anti")
    part = lambda c: parts.hint("merge").select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    open_pairs = open_pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    open_pairs = open_pairs.where(~F.coalesce("part_a", "a").eqNullSafe(F.coalesce("part_b", "b"))).select("a", "b")
    links = materialise(links.unionByName(confirmed(materialise(open_pairs, "open"), texts, width, percent)), "links")
    parts = connected_components(links, materialise)

    mixed = materialise(_placed(crowded.select(F.col("band").alias("key"), "node"), parts).select("node").distinct(), "mixed")
    groups = _prefixes(texts.join(mixed.hint("merge"), "node", "left_semi"), width, percent) if mixed.take(1) else None
    tried = stars
    while groups is not None:
        groups = materialise(_placed(groups, parts), "groups")
        leaders = materialise(_leaders(groups), "leaders")
        if not leaders.take(1):
            break
        others = groups.select("key", F.col("node").alias("other"), F.col("part").alias("other_part"))
        met = leaders.join(others.hint("merge"), "key").where("part != other_part").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        met = materialise(_plausible(met.join(tried.hint("merge"), ["a", "b"], "left_anti"), classes, percent), "met")
        tried = tried.unionByName(met)
        links = materialise(links.unionByName(confirmed(met, texts, width, percent)), "links")
        parts = connected_components(links, materialise)
        groups = groups.join(leaders.hint("merge"), ["key", "node"], "left_anti").select("key", "node")
    named = classes.join(parts.withColumnRenamed("node", "linked").hint("merge"), F.col("node") == F.col("linked"), "left")
    out = materialise(named.select("d1", "d2", "n", "node", F.coalesce("component", "node").alias("component"), "own"), "components")
    release(texts, crowded, mixed)
    return profile, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id of the component, ``kept`` whether the
    row has it.  A text of fewer than ``width`` words is one shingle; a null
    text or one without words has an empty set and is linked with nothing.  A
    row with a null id has a null component and is kept.  Rows that repeat an
    id are one document: all their texts are compared, and the id's component
    is that of everything linked with any of them.  Other columns aren't read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    profile, classes = _components(rows, width, percent)
    least = classes.groupBy("component").agg(F.min("own.id").alias("least"))
    named = classes.join(least.hint("merge"), "component").select("d1", "d2", "n", "component", "least")
    out = profile.select("id", "n", "d1", "d2").join(named.hint("merge"), ["d1", "d2", "n"], "left")
    several = materialise(out.where(F.col("id").isNotNull() & F.col("component").isNotNull()).groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b"), "several")
    if several.take(1):  # ids of several components: their rows join them
        held = out.where(F.col("component").isNotNull()).join(several.select("id", "a").hint("merge"), "id").select("a", F.col("component").alias("b"))
        joined = connected_components(held.distinct(), materialise).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        named = named.join(joined.hint("merge"), "component", "left").withColumn("component", F.coalesce("joined", "component"))
        least = named.groupBy("component").agg(F.min("least").alias("first"))
        named = named.join(least.hint("merge"), "component").select("d1", "d2", "n", F.col("first").alias("least"))
        out = profile.select("id", "n", "d1", "d2").join(named.hint("merge"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 75) -> DataFrame:
    """``docs`` with one row for each component of near duplicates: the one with the
    smallest id (and hash of its text, if an id has several texts).

    Rows without words stay, but of rows that repeat an id and a text one stays
    (which one, if other columns differ, isn't defined).  Rows that repeat an id
    with texts that aren't near duplicates all stay, as do rows with a null id.
    """
    key, digest = fresh(docs.columns, "key", "digest")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(digest, F.xxhash64(text))
    profile, classes = _components(own.select(F.col(key).alias("id"), F.col(digest).alias("h"), text.alias("text")), width, percent)
    chosen = classes.groupBy("component").agg(F.min("own").alias("own")).select(F.col("own.id").alias(key), F.col("own.h").alias(digest))
    wordless = profile.where(F.col("id").isNotNull() & (F.col("n") == 0)).select(F.col("id").alias(key), F.col("h").alias(digest)).distinct()
    rows = own.where(F.col(key).isNotNull()).join(chosen.unionAll(wordless).hint("merge"), [key, digest], "left_semi").dropDuplicates([key, digest])
    return rows.unionByName(own.where(F.col(key).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
