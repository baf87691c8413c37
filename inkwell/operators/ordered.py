"""Total orders and running sums over any number of rows, without a window over one partition.

Rows are range-partitioned and sorted; each partition numbers and sums its own rows, and
only one row a partition crosses the network to tell the others where they start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def with_previous(df: DataFrame, order: tuple[str, ...], cols: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``cols`` (new name: column) of the row before in the given order, within ``by``; null for the
    first. Rows of a group of any size lie in many range partitions; what crosses between
    partitions is the last row of each. The order must be total for the result to be defined."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = checkpointed(ranged).withColumn("_part", F.shiftrightunsigned("_at", 33))
    w = Window.partitionBy("_part", *by).orderBy("_at")
    out = kept.withColumns({**{f"_l_{k}": F.lag(F.struct(F.col(c).alias("v"))).over(w) for k, c in cols.items()}})
    last = kept.groupBy("_part", *by).agg(F.max_by(F.struct(*[F.col(c).alias(k) for k, c in cols.items()]), "_at").alias("_last"))
    # a row a partition and group: the last row of the nearest partition before that holds the group
    before = last.withColumn("_prev", F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", *by, "_prev")
    same = out["_part"] == before["_part"]
    for c in by:
        same = same & out[c].eqNullSafe(before[c])
    joined = out.join(before, same, "left")
    return joined.select(*[out[c] for c in df.columns], *[F.when(F.col(f"_l_{k}").isNotNull(), F.col(f"_l_{k}.v")).otherwise(F.col(f"_prev.{k}")).alias(k) for k in cols])


def with_position(df: DataFrame, *order, sums: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``pos`` (1, 2, ... in the given order) and ``sum_<c>`` (the running sum,
    this row included) for every column of ``sums``; within ``by`` where it is given.

    The order must be total for the result to be defined. The sorted rows are kept once
    (checkpoint), so that both passes see the same partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = checkpointed(ranged).withColumn("_part", F.shiftrightunsigned("_at", 33))
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = kept.withColumn("_pos", F.count(F.lit(1)).over(within))
    for c in sums:
        local = local.withColumn(f"_sum_{c}", F.sum(c).over(within))
    totals = kept.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    # one row a partition (and group): as many as the shuffle has partitions
    joined = local.join(starts, ["_part", *by])
    out = joined.withColumn("pos", F.col("_pos") + F.col("_n0"))
    for c in sums:
        out = out.withColumn(f"sum_{c}", F.coalesce(f"_sum_{c}", F.lit(0)) + F.col(f"_b_{c}"))
    return out.select(*df.columns, "pos", *[f"sum_{c}" for c in sums])
