"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code is the sign of each of its numbers, packed in 64-bit words and
cut into segments of about log2(n) bits.  Each distinct code is indexed once per
segment; the index is written once, in buckets of (segment, value), and every
round joins its probes to it without moving it again.  A query looks up, per
segment, all values within radius 0 of its own, then 1, 2, ...: a code that no
segment has met within radius r differs in at least r + 1 bits of every
segment.  With m segments all codes within m * (r + 1) - 1 bits are therefore
verified, and a query is done as soon as its k-th distance is no larger.

Of rows with one code only the k smallest ids can be in any result, so hot
codes shrink before the index is built.  A segment value that very many codes
share is spread over several keys, and its probes go to each.  A candidate
counts in the first segment and radius that meets it, so none counts twice.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridock.llm.scratch import materialise, release, shared_dir

#: Shortest and longest segment.
SEGMENT = (8, 24)
#: Codes of one segment value that stay under one key.
HOT = 20_000
#: Index rows of a bucket.
BUCKET_ROWS = 500_000
_PROBES = 200_000


def sign_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """(id, code) of (id, v): 1 where a number is positive; missing, null and NaN give 0."""
    words = -(-bits // 64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            n = np.asarray(lists.value_lengths())
            values = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            signs = np.zeros((len(n), 64 * words), bool)
            signs[row, place] = values > 0
            code = np.packbits(signs, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), words).cast(pa.list_(pa.int64()))], ["id", "code"])

    return vectors.mapInArrow(run, "id long, code array<long>")


def segments(bits: int, length: int) -> list[tuple[int, int, int]]:
    """(word, first bit, number of bits) of all segments: each word is cut into
    pieces of nearly equal length, ``length`` at most."""
    out = []
    for word, first in enumerate(range(0, bits, 64)):
        size = min(64, bits - first)
        parts = -(-size // length)
        edges = [size * k // parts for k in range(parts + 1)]
        out += [(word, a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def _mask(size: int, first: int = 0) -> int:
    """Bits first .. first + size - 1, as a signed 64-bit number."""
    m = ((1 << size) - 1) << first
    return m - (1 << 64) if m >> 63 else m


def _value(code: Column, segment: tuple[int, int, int]) -> Column:
    word, first, size = segment
    return F.shiftrightunsigned(code[word], first).bitwiseAND(F.lit(_mask(size)))


def _probe(cuts: list[tuple[int, int, int]], radius: int):
    """(qn, q, segment, value) of all values at distance ``radius`` of a query's own."""
    masks = {size: np.array([sum(1 << b for b in c) for c in combinations(range(size), radius)], np.int64) for size in {s for _, _, s in cuts}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _PROBES // max(1, sum(len(masks[s]) for _, _, s in cuts)))
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                code = np.asarray(part.column(1).flatten()).view(np.uint64).reshape(part.num_rows, -1)
                row, segment, value = [], [], []
                for j, (word, first, size) in enumerate(cuts):
                    own = (code[:, word] >> np.uint64(first)) & np.uint64((1 << size) - 1)
                    near = own.astype(np.int64)[:, None] ^ masks[size][None, :]
                    row.append(np.repeat(np.arange(part.num_rows), near.shape[1]))
                    segment.append(np.full(near.size, j, np.int32))
                    value.append(near.ravel())
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(segment)), pa.array(np.concatenate(value))], ["qn", "q", "segment", "value"])

    return run


def _met_first(cuts: list[tuple[int, int, int]], radius: int) -> Column:
    """No other segment has met the pair in a smaller radius, and none before it in this one."""
    tests = []
    for j, (word, first, size) in enumerate(cuts):
        apart = F.bit_count((F.col("q")[word].bitwiseXOR(F.col("code")[word])).bitwiseAND(F.lit(_mask(size, first))))
        tests.append((apart > radius) | (F.col("segment") == j) | ((F.col("segment") < j) & (apart == radius)))
    return reduce(lambda a, b: a & b, tests)


def _bucketed(index: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The index as a table of ``buckets`` files by (segment, value, salt), and its name."""
    spark = index.sparkSession
    name, path = f"scratch_index_{uuid.uuid4().hex}", f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    keys = ["segment", "value", "salt"]
    index.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._scratch_path = path
    return table, name


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): for each query the ``k`` rows of ``vectors``
    nearest in Hamming distance of sign codes, ties by id; all rows if there
    are fewer.

    A query that is itself a row of ``vectors`` finds itself.  Rows with a null
    id or a null or empty vector are neither found nor searched.  Of vectors of
    different lengths the shorter ones end in zeros.  Repeated rows of an id
    count once; an id with several vectors can be found, and asked, with each.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    bits = max(pick(df).agg(F.max(F.size("v")).alias("n")).first().n or 1 for df in (vectors, queries))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = sign_codes(pick(vectors), bits).distinct().withColumn("r", rank).where(F.col("r") <= k)
    codes = materialise(codes.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = materialise(sign_codes(pick(queries), bits).distinct(), "asked")
    known = codes.count()
    wanted = min(k, codes.select(F.explode("ids").alias("id")).distinct().limit(k).count())
    length = min(max(math.ceil(math.log2(max(known, 2))), SEGMENT[0]), SEGMENT[1])
    cuts = segments(bits, length)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(parallel, -(-known * len(cuts) // BUCKET_ROWS)), min(parallel, spark.sparkContext.defaultParallelism))

    values = codes.select("ids", "code", F.posexplode(F.array(*[_value(F.col("code"), c) for c in cuts])).alias("segment", "value"))
    hot = materialise(values.groupBy("segment", "value").agg(F.ceil(F.count("*") / HOT).cast("int").alias("keys")).where("keys > 1"), "hot")
    spread = bool(hot.take(1))
    if spread:
        salt = F.pmod(F.xxhash64("code"), F.coalesce("keys", F.lit(1))).cast("int")
        values = values.join(hot.hint("merge"), ["segment", "value"], "left").withColumn("salt", salt).drop("keys")
    else:
        values = values.withColumn("salt", F.lit(0))
    index, name = _bucketed(values, buckets)

    every = materialise(asked.select("code").distinct().select(F.monotonically_increasing_id().alias("qn"), F.col("code").alias("q")), "open")
    open_codes = every if wanted else every.limit(0)
    distance = reduce(lambda a, b: a + b, [F.bit_count(F.col("q")[w].bitwiseXOR(F.col("code")[w])) for w in range(-(-bits // 64))])
    done, best = [], None
    for radius in range(max(size for _, _, size in cuts) + 1):
        probes = open_codes.repartition(parallel).mapInArrow(_probe(cuts, radius), "qn long, q array<long>, segment int, value long")
        if spread:
            probes = probes.join(hot.hint("merge"), ["segment", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1)))
        else:
            probes = probes.withColumn("salt", F.lit(0))
        # probes multiply behind the planner's size estimate, so neither side may be broadcast
        met = probes.hint("merge").join(index, ["segment", "value", "salt"]).where(_met_first(cuts, radius))
        found = met.select("qn", distance.alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            found = found.unionByName(best.join(open_codes.select("qn").hint("merge"), "qn", "left_semi"))
        order = F.row_number().over(Window.partitionBy("qn").orderBy("distance", "id"))
        best = materialise(found.withColumn("rank", order).where(F.col("rank") <= wanted).select("qn", "distance", "id"), "best")
        state = best.groupBy("qn").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        finished = state.where((F.col("n") >= wanted) & (F.col("far") <= len(cuts) * (radius + 1) - 1)).select("qn")
        open_codes = materialise(open_codes.join(finished.hint("merge"), "qn", "left_anti"), "open")
        done.append(best.join(open_codes.select("qn").hint("merge"), "qn", "left_anti"))
        if radius == max(size for _, _, size in cuts):
            done.append(best.join(open_codes.select("qn").hint("merge"), "qn", "left_semi"))
        elif not open_codes.take(1):
            break
    results = reduce(DataFrame.unionByName, done)
    spark.sql(f"DROP TABLE {name}")
    release(index, codes, hot)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col)).cast("long")
    named = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(every.hint("merge"), "q").join(results.hint("merge"), "qn")
    named = named.select("query_id", F.col("id").alias(id_col), F.col("distance").cast("long").alias("distance"))
    return named.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", id_col, "distance")
