"""Filling fixed-capacity containers with items.

The plan is made over the histogram of item sizes, never over items: best fit, from the
largest size down, puts runs of equal items into runs of equally filled containers. The
plan is a list of segments (size, first rank, count, first container, items a container);
items then take their planned slots by joining on their rank within their size.

The histogram has at most ``capacity`` rows, whatever the corpus, so it may go to the
driver; items never do. Ranks within a size are dense, and a size that holds a third of
all items is ranked in as many buckets as it needs.

Defined results: null and empty texts (no tokens) are not assigned; an item larger than
the capacity has a container to itself; no other item is split; equal sizes are ranked by
id within hashed buckets, so a corpus gives the same plan again; duplicate ids each take
a slot of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

CAPACITY = 2048
#: Items that one bucket of a size may hold on average.
BUCKET_ITEMS = 250_000

Segment = tuple[int, int, int, int, int]


def plan_containers(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[Segment], int]:
    """Segments (size, first rank, count, first container, items a container) and the number of containers:
    the item of rank r of a segment goes to container ``first container + (r - first rank) // items``.

    The same containers as when items are placed one by one, largest first, each where the least
    room remains that takes it: that container stays the tightest until no more items of the size fit,
    so it takes all it has room for before the next is looked at, and rooms are visited once a size,
    least first. Containers that are filled alike stand side by side, as runs (first, end) under
    their remaining room.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    segments: list[Segment] = []
    made = 0

    def fill(size: int, rank: int, count: int, first: int, end: int, room: int) -> int:
        """Puts up to ``count - rank`` items into containers first..end of equal room; the rank after them."""
        each = room // size
        full = min((count - rank) // each, end - first)
        if full:
            segments.append((size, rank, full * each, first, each))
            rank, first = rank + full * each, first + full
            runs.setdefault(room - each * size, []).append((first - full, first))
        if first < end and rank < count:  # fewer than ``each`` are left
            segments.append((size, rank, count - rank, first, each))
            runs.setdefault(room - (count - rank) * size, []).append((first, first + 1))
            rank, first = count, first + 1
        if first < end:
            runs.setdefault(room, []).append((first, end))
        return rank

    for size, count in sorted(histogram, reverse=True):
        if size <= 0 or count <= 0:
            continue
        rank = 0
        for room in sorted(r for r in runs if r >= size):
            if rank == count:
                break
            for first, end in runs.pop(room):
                if rank == count:
                    runs.setdefault(room, []).append((first, end))
                else:
                    rank = fill(size, rank, count, first, end, room)
        if rank < count:
            more = -(-(count - rank) // (capacity // size)) if size <= capacity else count - rank
            rank = fill(size, rank, count, made, made + more, max(capacity, size))
            made += more
    return segments, made


def ranked(items: DataFrame, size_col: str, id_col: str, buckets: int) -> DataFrame:
    """Items with a dense ``rank`` from 0 within their size: the rank within a hashed bucket of
    the size, plus the items of the buckets before it."""
    b = items.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)))
    within = Window.partitionBy(size_col, "_bucket").orderBy(id_col)
    counts = b.groupBy(size_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(size_col, "_bucket", (F.sum("_n").over(Window.partitionBy(size_col).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    return b.withColumn("_in", F.row_number().over(within) - 1).join(before, [size_col, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def packed(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """id, n_tokens, container_id of every item of one token or more.

    sizes: id, n_tokens. They are computed once (the plan and the assignment both read them).
    """
    spark = sizes.sparkSession
    items = checkpointed(sizes.select(id_col, size_col).where(F.col(size_col) > 0))
    # one class for all oversized items keeps the histogram within capacity + 1 rows
    items = items.withColumn("_size", F.least(F.col(size_col), F.lit(capacity + 1)))
    histogram = [(r["_size"], r["count"]) for r in items.groupBy("_size").count().collect()]
    over = sum(c for s, c in histogram if s > capacity)
    segments, made = plan_containers([x for x in histogram if x[0] <= capacity], capacity)
    if over:
        segments.append((capacity + 1, 0, over, made, 1))
    if not segments:
        return items.select(id_col, size_col, F.lit(0).cast("bigint").alias("container_id")).limit(0)
    plan = spark.createDataFrame(segments, "_size int, _first bigint, _count bigint, _container bigint, _each bigint")
    buckets = max(16, -(-max(c for _, c in histogram) // BUCKET_ITEMS))
    slots = ranked(items, "_size", id_col, buckets)
    # the plan's rows follow from the capacity, not from the corpus
    out = slots.join(F.broadcast(plan), (slots["_size"] == plan["_size"]) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_count")))
    return out.select(id_col, size_col, (F.col("_container") + F.floor((F.col("rank") - F.col("_first")) / F.col("_each"))).alias("container_id"))


def fill_report(assigned: DataFrame, capacity: int = CAPACITY, size_col: str = "n_tokens") -> DataFrame:
    """One row: containers, the least number that the sizes allow, tokens, and the share of room used."""
    loads = assigned.groupBy("container_id").agg(F.sum(size_col).alias("load"))
    out = loads.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"), F.count_if(F.col("load") > capacity).alias("n_oversized"),
        F.sum(F.when(F.col("load") <= capacity, F.col("load"))).alias("_packed"),
    )
    packed_tokens = F.coalesce("_packed", F.lit(0))
    least = F.ceil(packed_tokens / capacity) + F.col("n_oversized")
    used = packed_tokens / F.expr("nullif(n_containers - n_oversized, 0)") / capacity
    return out.select("n_containers", least.cast("bigint").alias("least_containers"), "n_tokens", "n_oversized", F.round(used, 6).alias("room_used"))
