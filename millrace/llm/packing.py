"""Sequence packing, shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .frames import named, numbered, place
from .mixing import word_tokens

#: Placement tables of more rows than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_RUNS = 500_000


@dataclass(frozen=True)
class Run:
    """Ranks ``rank`` to ``rank + times * packs`` of ``length`` go to packs ``pack``...: slot after slot, ``packs`` ranks each."""

    length: int
    rank: int
    times: int
    packs: int
    pack: int
    slot: int
    offset: int


def plan_packs(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Shortest-pack-first placement of ``histogram`` (length to count) in packs of ``capacity``: runs and number of packs.

    Lengths are placed longest first. The groups of like packs are held by the room they have; a length goes to
    the pack with the most room, as often as it fits there, before the next is opened. Only counts of packing patterns
    are updated, so the work depends on the number of lengths and not of documents.
    """
    heap: list[tuple[int, int, int, int, int]] = []  # -room, first pack, packs, slots, filled
    runs: list[Run] = []
    packs = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie in 1..capacity")
        left, rank = histogram[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                room, first, size, slot, filled = heapq.heappop(heap)
                room = -room
            else:
                room, first, size, slot, filled = capacity, packs, max(1, -(-left // (capacity // length))), 0, 0
                packs += size
            if left < size:
                heapq.heappush(heap, (-room, first + left, size - left, slot, filled))
                size = left
            times = 1
            if not heap or -heap[0][0] < length:  # no other pack has room: fill these as far as they go
                times = min(room // length, left // size)
            elif room - length >= -heap[0][0]:
                times = min((room + heap[0][0]) // length, left // size) or 1
            runs.append(Run(length, rank, times, size, first, slot, filled))
            rank, left = rank + times * size, left - times * size
            if room - times * length:
                heapq.heappush(heap, (times * length - room, first, size, slot + times, filled + times * length))
    return runs, packs


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    tokens: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, pack_id, slot, pack_offset): the place of every document in packs of ``capacity``.

    ``tokens`` is a document's length, by default its number of words. A longer document is cut without loss into
    pieces of ``capacity`` and a rest. Keys and lengths are written to the shared folder once. The histogram (at most
    ``capacity`` rows, whatever the data) is planned on the driver; documents meet the plan by length and rank. A length
    of more than ``rows_per_task`` pieces is ranked in as many salted parts as that takes, which start behind one another by a
    table of their counts. Only keys and lengths are shuffled.

    Defined cases: null and empty texts have no tokens and one row with null pack_id, slot and pack_offset. The key keeps its
    type; null and repeated keys are documents like any other, and rows that can't be told apart may swap places, as may
    pieces of one length where it is ranked in parts. Very long texts are counted whole. Other columns are ignored, whatever
    their names. An empty table gives an empty table.
    """
    if capacity < 1 or rows_per_task < 1:
        raise ValueError("capacity and rows_per_task must be at least 1")
    spark = docs.sparkSession
    if tokens is None:
        sized = named(docs, doc_id=key, text=text).select("doc_id", word_tokens("text").alias("n"))
    else:
        sized = numbered(docs, F.coalesce(tokens, F.lit(0)).cast("long")).select(F.col(f"c{place(docs, key)}").alias("doc_id"), F.col(f"c{len(docs.columns)}").alias("n"))
    sized = written(sized.withColumn("u", F.monotonically_increasing_id()), "lengths")  # u tells rows of equal keys apart
    cap = F.lit(capacity).cast("long")
    cut = sized.filter("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / cap) - 1).cast("int")))).select(
        "doc_id", "u", "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("n") - F.col("piece") * cap).cast("int").alias("n_tokens")
    )
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()}  # at most capacity rows
    runs, _ = plan_packs(histogram, capacity)
    parts = [(n, -(-c // rows_per_task)) for n, c in histogram.items() if c > rows_per_task]
    first = F.lit(0).cast("long")
    if parts:
        cut = cut.join(_sent(spark.createDataFrame(parts, "l int, k long"), len(parts)), F.col("n_tokens") == F.col("l"), "left")
        cut = cut.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("u", "piece"), F.col("k")), F.lit(0).cast("long"))).drop("l", "k")
        counts = cut.groupBy(F.col("n_tokens").alias("l"), F.col("salt").alias("s")).agg(F.count(F.lit(1)).alias("c"))  # a row for each part
        before = Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("l", "s", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("long").alias("first"))
        cut = cut.join(_sent(counts, len(histogram) + sum(k for _, k in parts)), (F.col("n_tokens") == F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s")
        first = F.col("first")
    else:
        cut = cut.withColumn("salt", F.lit(0).cast("long"))
    places = spark.createDataFrame([(r.length, r.rank, r.rank + r.times * r.packs, r.packs, r.pack, r.slot, r.offset) for r in runs], "l2 int, rank0 long, rank1 long, packs long, pack0 long, slot0 int, offset0 int")
    local = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece", "u")) - 1
    met = cut.withColumn("rank", local + first)
    met = met.join(_sent(places, len(runs)), (F.col("n_tokens") == F.col("l2")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank1")), "left")
    nth = F.floor((F.col("rank") - F.col("rank0")) / F.col("packs"))
    empty = sized.filter("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n_tokens"), *(F.lit(None).cast(k).alias(c) for c, k in (("pack_id", "long"), ("slot", "int"), ("pack_offset", "int"))))
    return met.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        (F.col("pack0") + (F.col("rank") - F.col("rank0")) % F.col("packs")).alias("pack_id"),
        (F.col("slot0") + nth).cast("int").alias("slot"),
        (F.col("offset0") + nth * F.col("n_tokens")).cast("int").alias("pack_offset"),
    ).unionByName(empty)


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """To be broadcast where its number of rows is small."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_RUNS else table
