"""Contiguous shards of nearly equal bytes, cut by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.llm.tables import drop, join_checked, stored


def balanced_shards(df: DataFrame, n_shards: int, id: str = "doc_id", text: str = "text", *, overhead: int = 16) -> DataFrame:
    """Assign every row to one of `n_shards` shards, contiguous in id order, of nearly equal bytes.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of
    `df`: size is the text's UTF-8 bytes plus `overhead`, slot counts from 0 within the shard
    without gaps. A row goes to the shard in which the middle of its bytes falls, so no shard
    is off its equal share by more than half of its first and last rows.

    Only (id, size, checksum) is shuffled: rows are range-partitioned, each partition's total
    and count give the offsets of the next ones, and prefix sums run inside the partitions.
    Null texts count as empty. Rows are ordered by id (nulls first), checksum, size; equal
    rows by their place in the input, so one id with any number of rows is spread as well.
    Other columns of `df` are not read. An empty table gives an empty table.
    """
    spark = df.sparkSession
    text_bytes = F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b""))
    narrow = df.select(
        F.col(f"`{id}`").alias("id"),
        (F.octet_length(text_bytes) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text_bytes).alias("crc"),
    )
    rows, first = stored(narrow.withColumn("place", F.monotonically_increasing_id()), "sizes")
    order = [F.col(c) for c in ("id", "crc", "size", "place")]
    ranged, second = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    drop(spark, first)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets, third = stored(
        totals.select(
            F.col("part").alias("of"),
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("all_bytes"),
        ),
        "offsets",
    )
    local = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"sum": F.sum("size").over(local), "nth": F.row_number().over(local)})
    placed = join_checked(placed, offsets, {"part": "of"}, "inner", 40)
    # Twice the bytes up to the middle of the row, against the total, in exact integers.
    doubled = (2 * (F.col("bytes_before") + F.col("sum")) - F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.lit(n_shards - 1), F.floor(doubled * n_shards / (2 * F.col("all_bytes")).cast("decimal(38,0)")).cast("int"))
    cut, fourth = stored(
        placed.select("id", "size", "crc", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row")), "cut"
    )
    drop(spark, second, third)
    starts = F.broadcast(cut.groupBy("shard").agg(F.min("row").alias("start")).withColumnRenamed("shard", "of"))  # n_shards rows at most
    return cut.join(starts, cut["shard"] == starts["of"]).select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("row") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id: str = "doc_id") -> None:
    """Write the rows of `df` (with distinct ids) as one folder per shard, in slot order."""
    where = assigned.select(F.col(id).alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = df.join(where, df[id].eqNullSafe(where["__id"])).drop("__id")
    joined.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
