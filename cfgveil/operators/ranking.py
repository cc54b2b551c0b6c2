"""Global 1-based numbering without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.session import checkpointed


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add `idx` (1-based position within the group by `order`) and `total` (group size).

    Rows are range-partitioned by group and order, so one group of any size spreads over
    many tasks; each partition numbers its own rows, and the partition sizes, one small
    row per group and partition, give the offsets. The range partitioning is checkpointed
    first: positions and sizes must come from one and the same layout even when an
    executor is lost in between.
    """
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    fixed = checkpointed(ranged)
    sizes = fixed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"__g_{g}") for g in group],
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(whole).alias("total"),
    )
    local = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return (
        fixed.withColumn("__local", local)
        .join(offsets, on)
        .withColumn("idx", (F.col("__local") + F.col("__offset")).cast("bigint"))
        .drop("__part", "__local", "__offset", "__p", *[f"__g_{g}" for g in group])
    )
