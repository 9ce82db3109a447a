"""Shards of near equal bytes by longest-processing-time scheduling.

Groups of equal texts stay together. Sorted by size, each goes to the
least-loaded shard, which a heap gives. Groups are far too many for one heap, so
the heap works on size classes: a group of at least 1/HEAVY of all bytes is a
class of its own (there are at most HEAVY), smaller ones share a class with those
within 1/FINE of their size (sizes up to FINE bytes: of exactly their size). The
number of classes is bounded by HEAVY + FINE * (1 + ln(largest size / FINE)),
whatever the number of groups, so the driver may hold them. A run of equal groups
is dealt in one step to where the heap would have put them one by one.

Defined results: null text is the group of the empty text, of size 1 a row;
repeated rows are separate rows of one group; a null doc_id is a row like any
other; an empty table gives no rows; one group larger than a fair share fills a
shard alone and the others share the rest. Other columns are not looked at."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import gapless, written
from quarry.shipping import ship

HEAVY = 4096
FINE = 2048
BUCKETS = 1024
#: Classes up to this number are broadcast with their plan; more are joined by shuffle.
BROADCAST_CLASSES = 50_000


def size_class(size: Column) -> Column:
    """Number of the class of a light group's size: the size itself up to FINE, then steps of 1/FINE."""
    fine = F.lit(float(FINE))
    return F.when(size <= FINE, size.cast("long")).otherwise((fine * (F.lit(1.0) + F.log(size / fine))).cast("long"))


def deal(classes: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """How many groups of each class each shard gets.

    classes: (size, number of groups), largest first. Equal groups go one by one
    to the least-loaded shard (the lowest number on ties). A short run uses the
    heap itself; a long one finds the level that the heap would reach: shard j
    takes its k-th group at load[j] + k * size, and the smallest such levels win."""
    heap = [(0.0, j) for j in range(shards)]
    out = []
    for size, n in classes:
        got = [0] * shards
        if n > 4 * shards:
            loads = dict((j, load) for load, j in heap)
            low, high = min(loads.values()), max(loads.values()) + size * (n + 1)
            taken = lambda level: sum(max(0, math.ceil((level - x) / size)) for x in loads.values())  # noqa: B023, E731
            for _ in range(200):  # the highest level below which at most n groups begin
                mid = (low + high) / 2
                if mid in (low, high):
                    break
                low, high = (mid, high) if taken(mid) <= n else (low, mid)
            for j, load in loads.items():
                got[j] = max(0, math.ceil((low - load) / size))
            heap = [(load + got[j] * size, j) for j, load in loads.items()]
            heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, j = heapq.heappop(heap)
            got[j] += 1
            heapq.heappush(heap, (load + size, j))
        out.append(got)
    return out


def shard(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """docs(doc_id, text) to doc_id, size, text_crc32, shard and slot.

    Only ids, sizes and hashes are shuffled, never texts. The join by group is
    between two shuffled tables, whose hot keys adaptive execution splits."""
    ship(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("group")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("weight") * HEAVY >= F.lit(total)
    # Heavy groups have negative classes, so they stay apart from the light ones.
    groups = written(groups.withColumn("class", F.when(heavy, -F.col("weight")).otherwise(size_class(F.col("weight")))))
    classes = sorted(((r.w / r.n, r.n, r["class"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()), reverse=True)
    dealt = deal([(size, n) for size, n, _ in classes], shards)
    ends = []
    for (_, _, c), got in zip(classes, dealt, strict=True):
        at = 0
        for j, k in enumerate(got):
            if k:
                ends.append((c, at, at + k, j))
                at += k
    spark = docs.sparkSession
    plan = spark.createDataFrame(ends, "class long, first long, last long, shard int")
    plan = plan.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("ends"))  # at most one entry per shard
    numbered = gapless(groups, "class", ["group"], "rank", BUCKETS)
    placed = numbered.join(F.broadcast(plan) if len(classes) <= BROADCAST_CLASSES else plan, "class").select("group", F.expr("filter(ends, x -> x.last > rank)[0].shard").alias("shard"))
    out = rows.join(written(placed), "group").select("doc_id", "size", "text_crc32", "shard")
    return gapless(out, "shard", ["doc_id", "text_crc32"], "slot", BUCKETS)

