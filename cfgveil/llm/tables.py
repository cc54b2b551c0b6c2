"""Tables between the jobs of one operator, joins with null-safe keys, checked broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.session import new_dir

# A side of a join is broadcast only if its counted rows need at most this many bytes.
BROADCAST_BYTES = 16 << 20


def save(df: DataFrame, purpose: str, *, blobs: bool = False) -> str:
    """Write `df` below the shared folder and give the path. `blobs`: rows hold megabytes each."""
    path = new_dir(df.sparkSession, purpose)
    writer = df.write
    if blobs:  # already compressed; small row groups, so that a reader holds few rows at once
        writer = writer.option("compression", "none").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return path


def stored(df: DataFrame, purpose: str, *, blobs: bool = False) -> tuple[DataFrame, str]:
    """`df` written once and read back, with its path for `drop`."""
    path = save(df, purpose, blobs=blobs)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables whose last reader is done."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def same(left: Column, right: Column) -> Column:
    """Null-safe equality."""
    return left.eqNullSafe(right)


def join_checked(df: DataFrame, small: DataFrame, on: dict[str, str], how: str, row_bytes: int) -> DataFrame:
    """Null-safe join with a table that is stored already; `on`: column of df -> column of small.

    The small side is broadcast if rows times `row_bytes` stay below BROADCAST_BYTES, and
    sort-merged, where adaptive execution splits hot keys, if not.
    """
    side = F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small.hint("merge")
    return df.join(side, reduce(Column.__and__, [same(df[a], side[b]) for a, b in on.items()]), how)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
