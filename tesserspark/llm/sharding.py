"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are the jobs: sorted by size, each goes to the
least-loaded shard.  What the schedule needs to know of a group is its size alone, so groups of equal
size are one class, and the driver schedules classes: of each, how many groups every shard gets.  The
result is that of the heap over all groups, one by one.  There are at most sqrt(2 * bytes) classes,
as their sizes differ; that is 14 million for 100 TB, and with texts below 1 MB a million at most.

Which groups of a class a shard gets goes by their rank in the class; classes of very many groups are
ranked in cells, so a size that a third of all groups have is spread over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserspark.llm.common import materialize

#: Rows of one shard are numbered in SUBSHARDS parts; a class is ranked in cells of about CELL_GROUPS groups; what has 1/GRAIN of all bytes is met by broadcast.
SHARDS, SUBSHARDS, CELL_GROUPS, GRAIN = 24, 256, 100_000, 4_096
#: Placed groups (16 bytes each) are broadcast up to this many, counted first; beyond, rows are shuffled to them.
BROADCAST_ROWS = 1_000_000


def schedule(jobs: list[tuple[int, object]], shards: int) -> dict:
    """Longest first, each to the least-loaded shard; ties go to the lower key and the lower shard."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, key in sorted(jobs, key=lambda job: (-job[0], job[1])):
        load, shard = heap[0]
        out[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def _many(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal jobs the heap gives each shard: the least values of all loads + j * size, ties to the lower shard."""

    def upto(top: int) -> list[int]:
        return [(top - x) // size + 1 if top >= x else 0 for x in loads]

    low, high = min(loads) - 1, min(loads) + size * count
    while high - low > 1:  # the highest level that takes no more than the jobs there are
        mid = (low + high) // 2
        low, high = (mid, high) if sum(upto(mid)) <= count else (low, mid)
    taken = upto(low)
    for k, (more, now) in enumerate(zip(upto(low + 1), taken)):
        if more > now and sum(taken) < count:
            taken[k] += 1
    return taken


def schedule_classes(classes: Iterable[tuple[int, int]], shards: int, few: int = 256) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(size, count, [(shard, how many)]) of classes (size, count) of equal jobs, longest first, as the heap over all jobs would have it."""
    heap, out = [(0, k) for k in range(shards)], []
    for size, count in sorted(classes, reverse=True):
        got = [0] * shards
        if count <= few:
            for _ in range(count):
                load, k = heap[0]
                got[k] += 1
                heapq.heapreplace(heap, (load + size, k))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            got = _many(loads, size, count)
            heap = [(load + size * n, k) for k, (load, n) in enumerate(zip(loads, got))]
            heapq.heapify(heap)
        out.append((size, count, [(k, n) for k, n in enumerate(got) if n]))
    return out


def _keyed(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        (F.octet_length(text) + 8).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        F.xxhash64(text).alias("__group"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SUBSHARDS)).cast("int").alias("__sub"),
    ]


def assign(groups: DataFrame, shards: int, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """(g, placed_shard) of every row (__group, bytes) of ``groups``, which is read several times."""
    spark = groups.sparkSession
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most sqrt(2 * bytes) rows
    rows = []
    for size, n, got in schedule_classes(((r["bytes"], r["n"]) for r in classes), shards):
        upto, ends = 0, []
        for k, many in got:
            upto += many
            ends.append((k, upto))
        rows.append((size, -(-n // cell_groups), ends))
    table = spark.createDataFrame(rows, "size long, cells long, ends array<struct<shard: int, upto: long>>")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    celled = groups.join(table, F.col("bytes") == F.col("size")).withColumn("cell", F.pmod(F.xxhash64(F.lit(7), F.col("__group")), F.col("cells")))
    # rows of (class, cell) of the classes that have several; the cells before one hold the lower ranks
    counts = celled.where("cells > 1").groupBy("size", "cell").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("size").alias("ssize"), F.col("cell").alias("scell"), before.alias("start"))
    within = F.row_number().over(Window.partitionBy("size", "cell").orderBy("__group")) - 1
    ranked = celled.withColumn("within", within).join(F.broadcast(starts), (F.col("size") == F.col("ssize")) & (F.col("cell") == F.col("scell")), "left")  # one row a cell_groups groups
    rank = F.col("within") + F.coalesce("start", F.lit(0))
    return ranked.withColumn("rank", rank).select(F.col("__group").alias("g"), F.get(F.filter("ends", lambda e: e["upto"] > F.col("rank")), F.lit(0))["shard"].alias("placed_shard"))


def _to_shards(rows: DataFrame, narrow: DataFrame, shards: int, cell_groups: int, broadcast_rows: int):
    """A function that adds __shard to tables with __group."""
    groups = materialize(narrow.groupBy("__group").agg(F.sum("__size").alias("bytes")), "groups")
    placed = materialize(assign(groups, shards, cell_groups).join(groups, F.col("g") == F.col("__group")).select("g", "placed_shard", "bytes"), "placed")
    stats = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if stats["n"] <= broadcast_rows:
        return lambda df: df.join(F.broadcast(placed.drop("bytes")), F.col("__group") == F.col("g")).withColumn("__shard", F.col("placed_shard")).drop("g", "placed_shard")
    least = max(1, -(-stats["bytes"] // GRAIN))
    large = placed.where(F.col("bytes") >= least).select(F.col("g").alias("lg"), F.col("placed_shard").alias("large_shard"))  # GRAIN rows at most
    small = placed.where(F.col("bytes") < least).drop("bytes")

    def add(df: DataFrame) -> DataFrame:
        met = df.join(F.broadcast(large), F.col("__group") == F.col("lg"), "left")
        hot = met.where("lg is not null").withColumn("__shard", F.col("large_shard")).drop("lg", "large_shard")
        rest = met.where("lg is null").drop("lg", "large_shard").join(small, F.col("__group") == F.col("g")).withColumn("__shard", F.col("placed_shard")).drop("g", "placed_shard")
        return hot.unionByName(rest)

    return add


def _placed(rows: DataFrame, narrow: DataFrame, shards: int, cell_groups: int, broadcast_rows: int) -> DataFrame:
    """``rows`` with __shard and __slot."""
    to_shards = _to_shards(rows, narrow, shards, cell_groups, broadcast_rows)
    counts = to_shards(narrow).groupBy("__shard", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__shard").alias("__s"), F.col("__sub").alias("__u"), before.alias("__start"))  # shards * SUBSHARDS rows at most
    within = F.row_number().over(Window.partitionBy("__shard", "__sub").orderBy("__key", "__group")) - 1
    dealt = to_shards(rows).withColumn("__within", within)
    return dealt.join(F.broadcast(starts), (F.col("__shard") == F.col("__s")) & (F.col("__sub") == F.col("__u"))).withColumn("__slot", F.col("__start") + F.col("__within"))


def _outputs() -> list[Column]:
    return [
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]


def shard(docs: DataFrame, shards: int = SHARDS, cell_groups: int = CELL_GROUPS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``bytes``: sizes near equal, as far as groups that stay together allow.  A null text
    counts as an empty one.  Rows of equal texts share a shard, repeated rows each have a slot, texts
    of any length are one row, groups of equal size go by their hash, an empty table gives no rows,
    and other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").alias("__key"), *_keyed(docs))
    # which part numbers a row is written down here, so rows that repeat may be dealt by where they lie
    spread = F.pmod(F.xxhash64("__sub", F.shiftright(F.monotonically_increasing_id(), 12)), F.lit(SUBSHARDS)).cast("int")
    narrow = materialize(keyed.withColumn("__sub", spread), "sizes")
    return _placed(narrow, narrow, shards, cell_groups, broadcast_rows).select(F.col("__key").alias("doc_id"), *_outputs())


def sharded_documents(docs: DataFrame, shards: int = SHARDS, cell_groups: int = CELL_GROUPS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` with the columns of ``shard``; of clashing names the operator's columns stay.

    Null and empty texts, repeated rows and an empty table are as in ``shard``; rows that repeat in
    full are numbered by one task.
    """
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    carried = [c for c in docs.columns if c not in made]
    narrow = materialize(docs.select(*_keyed(docs)), "sizes")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(carried)], F.col("doc_id").alias("__key"), *_keyed(docs))
    placed = _placed(rows, narrow, shards, cell_groups, broadcast_rows)
    return placed.select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(carried)], *_outputs())
