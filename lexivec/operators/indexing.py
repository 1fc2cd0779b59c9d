"""Distributed dense row numbering (G4, E15 row ids, G1 quotas).

A ``row_number()`` over a window without ``PARTITION BY`` moves every row into
one task.  ``global_index`` instead range-partitions on the order, numbers rows
inside each partition, and adds the running total of the partition sizes (one
small row per partition).  The numbered table is written into the shared
checkpoint folder first, with the partition each row was numbered in, so the
layout the offsets were computed from is the one that gets joined back, even
after a lost executor or an AQE re-plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import ensure_checkpoint_dir


def materialize(df: DataFrame, wide: bool = False) -> DataFrame:
    """Cut lineage: the rows as Parquet in the shared ``spark.checkpoint.dir``, made once (an
    eager checkpoint runs the last stage twice, and stores its rows as they are in memory).
    ``wide`` rows, of megabytes each, go to a reliable checkpoint, which is read row by row."""
    folder = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    if wide:
        return df.checkpoint()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_index(df: DataFrame, order_cols: list, col: str = "idx", start=0,
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based (plus ``start``) dense index following ``order_cols``.

    ``order_cols`` must be a total order (include a unique key) for the index to
    be reproducible.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ranged = materialize(ranged)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(col, (F.col("_off") + F.col("_local") + start_col).cast("long")) \
              .drop("_pid", "_local", "_off")


def rank_within(df: DataFrame, group_cols: list, order_cols: list, col: str = "rank",
                small_groups: bool = False) -> DataFrame:
    """1-based rank inside each group without funnelling a group into one task.

    Rows are globally indexed by ``group_cols + order_cols``; a group's rank is
    its index minus the group's first index.  ``small_groups`` marks the group
    table as bounded (a fixed set of types) so it is broadcast.
    """
    indexed = global_index(df, list(group_cols) + list(order_cols), col="_gidx")
    firsts = indexed.groupBy(*group_cols).agg(F.min("_gidx").alias("_first"))
    if small_groups:
        firsts = F.broadcast(firsts)
    out = indexed.join(firsts, list(group_cols))
    return out.withColumn(col, (F.col("_gidx") - F.col("_first") + 1).cast("long")).drop("_gidx", "_first")
