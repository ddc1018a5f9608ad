"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks.  With integer weights w that sum
to Q, block i of a source is released at floor(i * Q / w) and due at
ceil((i + 1) * Q / w); slots go to the released block that is due first.  On
one resource this earliest-deadline-first rule meets every deadline, so after
any number of slots each source is less than one block away from its share.
The schedule repeats every Q slots, hence only one period is simulated and
every block's slot follows by arithmetic: nothing is scheduled row by row.

Documents are numbered within their source over range partitions of
(source, id), so a source that holds a third of all rows is numbered by many
tasks.  When a source runs out its slots stay empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridock.llm.scratch import fresh, materialise

#: Most sources, and most slots of a period, that the driver schedules; one executor
#: task schedules larger ones, slot by slot.
DRIVER_SOURCES = 100_000
DRIVER_PERIOD = 1_000_000


def schedule(weights: Iterable[tuple[str, int]], total: int) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of one period of ``total`` slots, by earliest deadline
    first (ties by source); ``weights`` is sorted by source.  Memory grows with the
    sources, not with the slots."""
    weight = dict(weights)
    waiting = [(0, s, 0) for s in weight]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weight[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, t
        if i + 1 < weight[s]:
            heapq.heappush(waiting, ((i + 1) * total // weight[s], s, i + 1))


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of one period for each source."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights must be positive integers")
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for s, _, t in schedule(sorted(weights.items()), sum(weights.values())):
        slots[s].append(t)
    return slots


def _planned(shares: DataFrame, total: int) -> DataFrame:
    """(source, turn, first_slot) of one period, made in one task that sees the
    sources only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((s, w) for b in batches for s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        part: list[tuple[str, int, int]] = []
        for row in schedule(own, total) if own else ():
            part.append(row)
            if len(part) == 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["source", "turn", "first_slot"])
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["source", "turn", "first_slot"])

    return shares.coalesce(1).mapInArrow(run, "source string, turn long, first_slot long")


def mix(docs: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, block, slot, place) for every row of ``docs``; reading by slot
    and then place gives the mix.

    Within a source documents keep the order of their ids, null ids first.  A
    null source counts as the empty one.  Repeated rows are rows of their own.
    Sources without a weight get ``default_weight``; weights of sources that
    are absent are ignored, and common factors of weights cancel out.  Other
    columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    ranged = materialise(rows.repartitionByRange("source", "id").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("n"))
    given = spark.createDataFrame([(s, int(w)) for s, w in weights.items()], "source string, given long")  # as many rows as the caller named
    shares = counts.select("source").distinct().join(F.broadcast(given), "source", "left").select("source", F.coalesce("given", F.lit(int(default_weight))).alias("weight"))
    shares = materialise(shares, "shares")
    kinds = [r.weight for r in shares.select("weight").distinct().collect()]  # at most one more than the caller named
    if any(w < 1 for w in kinds):
        raise ValueError("weights must be positive integers")
    factor = math.gcd(*kinds) if kinds else 1
    shares = shares.withColumn("weight", (F.col("weight") / factor).cast("long"))
    size = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total")).first()
    if size.n <= DRIVER_SOURCES and size.total <= DRIVER_PERIOD:
        slots = period({r.source: r.weight for r in shares.collect()})
        plan = spark.createDataFrame([(s, k, t) for s, own in slots.items() for k, t in enumerate(own)], "source string, turn long, first_slot long")
    else:
        plan = materialise(_planned(shares, size.total), "schedule")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("id")) - 1
    numbered = ranged.withColumn("number", number.cast("long")).join(offsets, ["source", "part"]).withColumn("number", F.col("number") + F.col("before"))
    blocks = numbered.withColumn("block", F.floor(F.col("number") / block_rows)).join(shares, "source").withColumn("turn", F.col("block") % F.col("weight"))
    placed = blocks.join(plan, ["source", "turn"])
    slot = F.floor(F.col("block") / F.col("weight")) * F.lit(size.total) + F.col("first_slot")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", slot.alias("slot"), (F.col("number") % block_rows).alias("place"))


def mixed_documents(docs: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with the columns ``mix_slot`` and ``mix_place`` (with an underscore
    more where ``docs`` has such a column); rows that repeat an id and source share
    out its places.  Null ids and sources are placed like any other."""
    slot_col, place_col, key, origin, nth = fresh(docs.columns, "mix_slot", "mix_place", "own_key", "own_source", "own_number")
    order = mix(docs, weights, default_weight, block_rows, id_col, source_col)
    same = lambda *by: F.row_number().over(Window.partitionBy(key, origin).orderBy(*by))
    places = order.select(F.col(id_col).alias(key), F.col(source_col).alias(origin), F.col("slot").alias(slot_col), F.col("place").alias(place_col))
    places = places.withColumn(nth, same(slot_col, place_col))
    own = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(origin, F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))).withColumn(nth, same(F.lit(0)))
    on = own[key].eqNullSafe(places[key]) & (own[origin] == places[origin]) & (own[nth] == places[nth])
    return own.join(places, on).select(*[own[f"`{c}`"] for c in docs.columns], slot_col, place_col)
