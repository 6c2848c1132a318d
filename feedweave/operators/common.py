"""Plan-shaping helpers shared by the operators.

* ``sized_broadcast`` broadcasts a side only after proving its row count is
  under a bound; beyond the bound the join is left to Spark (sort-merge, or an
  AQE runtime switch).
* ``dense_ordinal`` numbers rows 1..n inside a *low-cardinality* group (a digest
  type, a run) without a single-partition window: range-partitioned sort, a
  reliable checkpoint so partition boundaries are fixed, per-partition counts
  (a table of #partitions x #groups rows), and a broadcast of those offsets.
* ``running_total`` is the same with weights: the sum of what comes before a row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.session import reliable_checkpoint

# Row bound under which a dimension/config side may be broadcast.
BROADCAST_MAX_ROWS = 200_000
# Byte bound of the same side, as text.
BROADCAST_MAX_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` provably has at most ``max_rows`` rows and ``BROADCAST_MAX_BYTES`` bytes."""
    wide = [c for c, kind in df.dtypes if kind not in ("int", "bigint", "smallint", "tinyint", "boolean", "date", "timestamp", "double", "float")]
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for c in wide:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).first()
    small = seen["n"] <= max_rows and (seen["size"] or 0) <= BROADCAST_MAX_BYTES
    return F.broadcast(df) if small else df


def ts_lit(value) -> Column:
    """A UTC timestamp literal from a datetime / ISO string (session zone is UTC)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(str(value)).cast("timestamp")


def date_lit(value) -> Column:
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(str(value)).cast("date")


def bounded_broadcast(df: DataFrame, bound_rows: int | None,
                      max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast when a caller-proven row bound is under ``max_rows``; else count first."""
    if bound_rows is None:
        return sized_broadcast(df, max_rows)
    return F.broadcast(df) if bound_rows <= max_rows else df


def dense_ordinal(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                  name: str = "ordinal", max_groups: int | None = None) -> DataFrame:
    """Add ``name`` = 1..n per ``group_cols`` following ``order_cols`` (must be a total order).

    Intended for groups that are few and large (e.g. one per digest type),
    where ``row_number() over (partition by type ...)`` would put a whole type
    in one task.  ``max_groups`` (a bound on distinct groups, e.g. the number of
    configured digest types) lets the offsets table be broadcast without a
    count: range partitioning keeps each group's rows contiguous, so it has at
    most ``#partitions + max_groups`` rows.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = reliable_checkpoint(ordered)
    tagged = fixed.select(
        "*",
        F.spark_partition_id().alias("_fw_part"),
        (F.monotonically_increasing_id()
         - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("_fw_local"),
    )
    stats = (tagged.groupBy("_fw_part", *group_cols)
             .agg(F.count(F.lit(1)).alias("_fw_n"), F.min("_fw_local").alias("_fw_first")))
    w = (Window.partitionBy(*group_cols).orderBy("_fw_part")
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = stats.select("_fw_part", *group_cols, "_fw_first",
                           F.coalesce(F.sum("_fw_n").over(w), F.lit(0)).alias("_fw_before"))
    # a range repartition without a count uses spark.sql.shuffle.partitions and AQE
    # only coalesces, so that setting bounds the partition count
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bound = None if max_groups is None else n_parts + max_groups
    joined = tagged.join(bounded_broadcast(offsets, bound), ["_fw_part", *group_cols], "inner")
    return joined.select(
        *[c for c in df.columns],
        (F.col("_fw_before") + F.col("_fw_local") - F.col("_fw_first") + 1).alias(name),
    )


def running_total(df: DataFrame, group_cols: list[str], order_cols: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group that come before, by ``order_cols`` (a total order).

    As ``dense_ordinal``: range partitions, fixed by a reliable checkpoint, and
    a table of their sums; the sum inside a range partition is a window over
    that partition's rows only, so no task holds a whole group.
    """
    keys = [F.col(c) for c in [*group_cols, *order_cols]]
    fixed = reliable_checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    tagged = fixed.withColumn("_fw_part", F.spark_partition_id())
    sums = tagged.groupBy("_fw_part", *group_cols).agg(F.sum(weight).alias("_fw_sum"))
    earlier = Window.partitionBy(*group_cols).orderBy("_fw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_fw_part", *group_cols, F.coalesce(F.sum("_fw_sum").over(earlier), F.lit(0)).alias("_fw_before"))
    inside = Window.partitionBy("_fw_part", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged.withColumn("_fw_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = placed.join(sized_broadcast(offsets), ["_fw_part", *group_cols])
    return joined.select(*df.columns, (F.col("_fw_before") + F.col("_fw_own")).alias(name))
