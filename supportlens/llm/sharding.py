"""Shards of near equal size by longest-processing-time scheduling.

Groups that must stay together are sized by an aggregate and counted by size. The scheduler
takes the sizes from the largest on; groups of one size are dealt together, which gives the
same loads as one by one through a heap: each goes to the least loaded shard. A group then
gets the shard of its rank among those of its size. So the driver sees one row per size, and
sizes beyond ``BITS`` binary digits are cut to these, so that the rows are bounded.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from supportlens.llm.common import text_of
from supportlens.session import materialize

SHARDS = 16
#: Leading binary digits of a size that are told apart: about 1,000 sizes for each doubling.
BITS = 11
#: Rows that a cell holds, by expectation; ranks and slots are counted cell by cell.
CELL_ROWS = 2000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets, one after the other to the least loaded.

    The items begin at the ``count`` smallest of load, load + size, load + 2 size, … of all
    shards. All that begin below a level are counted at once; fewer than one per shard are left for the heap.
    """
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
    while low < high:
        level = (low + high + 1) // 2
        if sum(below(level)) <= count:
            low = level
        else:
            high = level - 1
    given = below(low)
    heap = [(load + size * n, shard) for shard, (load, n) in enumerate(zip(loads, given, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        given[shard] += 1
    return given


def schedule_sizes(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(class, groups, bytes) of all sizes to (class, ranks at which the next shard begins)."""
    loads = [0] * shards
    out = []
    for name, count, total in sorted(sizes, reverse=True):
        size = max(1, round(total / count))
        given = deal(loads, size, count)
        borders, at = [], 0
        for shard, n in enumerate(given):
            loads[shard] += n * size
            at += n
            borders.append(at)
        out.append((name, borders))
    return out


def _size_class(size: str) -> Column:
    """The size cut to its leading digits."""
    return F.expr(f"shiftleft(shiftright({size}, greatest(length(bin({size})) - {BITS}, 0)), greatest(length(bin({size})) - {BITS}, 0))")


def _numbered(rows: DataFrame, keys: list[str], sizes: DataFrame, seed: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of equal ``keys`` that come before a row.

    Rows come by cell, a hash of ``seed``, and ``order`` inside it. ``sizes`` has keys and n_rows, of which the number of
    cells follows, so that no task gets a whole group.
    """
    cells = F.greatest(F.ceil(F.col("n_rows") / CELL_ROWS), F.lit(1))
    dealt = rows.join(sizes, keys).withColumn("cell", F.pmod(F.xxhash64(*seed), cells)).drop("n_rows")
    counts = dealt.groupBy(*keys, "cell").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "cell").orderBy(*order)
    earlier = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(starts, [*keys, "cell"]).withColumn(name, F.col("_start") + earlier).drop("cell", "_start")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each row of ``docs`` (doc_id, text); rows of equal text stay together.

    Size is the UTF-8 bytes of the text plus one; null counts as empty. Groups, known by the SHA-256 of
    their text, go longest first to the least loaded shard; those of equal size by hash cell and digest. Slots
    count from 0 in each shard, by hash cell, doc_id and text checksum; rows that are equal in all are counted
    together and get slots of their own. Rows that repeat a doc_id, or have none, are rows like any other. Further
    columns are ignored; an empty table gives none.

    The driver gets one row per size of a group, at most 2^10 for each doubling of the size.
    """
    text = text_of()
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = materialize(
        rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("class", _size_class("bytes")), "shard-groups"
    )
    sizes = groups.groupBy("class").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("bytes")).collect()
    borders = schedule_sizes([(row["class"], row["n_rows"], row["bytes"]) for row in sizes], shards)
    classes = spark.createDataFrame([(row["class"], row["n_rows"]) for row in sizes], "class long, n_rows long")
    ranked = _numbered(groups.withColumn("one", F.lit(1)), ["class"], classes, ["group"], ["group"], "one", "rank")
    scheduled = ranked.join(spark.createDataFrame(borders, "class long, borders array<long>"), "class")
    shard_of = materialize(
        scheduled.select("group", F.size(F.filter("borders", lambda border: border <= F.col("rank"))).alias("shard")), "shard-of-group"
    )
    same = ["doc_id", "size", "text_crc32", "shard"]
    dealt = materialize(rows.join(shard_of, "group").groupBy(*same).agg(F.count("*").alias("copies")), "dealt-rows")
    held = dealt.groupBy("shard").agg(F.count("*").alias("n_rows"))
    order = ["doc_id", "text_crc32", "size"]
    placed = _numbered(dealt, ["shard"], held, order, order, "copies", "first_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
