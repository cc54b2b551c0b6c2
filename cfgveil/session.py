"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table of at most this many rows and bytes is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "cfgveil", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators rely on; an existing one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A rule chain is made of a few thousand column calls; noting the call site of
        # each costs more than analysing them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or what `setCheckpointDir` was given.

    Only where neither names one and all runs on one machine (a local master) a new
    temporary folder is made and remembered in the session; a cluster raises.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cfgveil.scratch.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="cfgveil-")
        spark.conf.set("cfgveil.scratch.dir", named)
    return named.rstrip("/")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what operators have written for themselves meanwhile.

    For jobs that write their results inside: a DataFrame returned from here must not read
    an operator's own tables any more.
    """
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        for path in _SCRATCH.get():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _SCRATCH.reset(token)


def new_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written once to a table in the shared folder and read back from it."""
    out = new_dir(df.sparkSession, purpose)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def join_lookup(
    df: DataFrame, lookup: DataFrame, on: str | list[str], how: str = "inner", *, max_rows: int = BROADCAST_ROWS, parts: int = 0
) -> DataFrame:
    """Join (inner or left) with a lookup table whose size is known before the plan is made.

    The lookup is written once, counted and measured (the length of its rows as JSON):
    broadcast if it is small, sort-merge (where adaptive execution splits hot keys) if not. `df` itself is never broadcast, however
    small the optimizer takes it to be: it may be the output of an explode, whose growth
    the optimizer's estimates ignore.
    """
    fixed = materialized(lookup, "lookup")
    size = fixed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    small = size["rows"] <= max_rows and (size["bytes"] or 0) <= BROADCAST_BYTES
    if small:
        return df.join(F.broadcast(fixed), on, how)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(parts, *([on] if isinstance(on, str) else on))
    return df.join(fixed.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the input has fewer splits than the cluster has cores.

    A no-op for inputs of any size worth a cluster; it helps a small file with one row
    group, whose rows would all land in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Rows that a task takes of a narrow table from which long texts are made.
ROWS_PER_TASK = 16_384


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The `rows` narrow rows of `df` dealt out evenly, whatever its files' row groups, before texts are made of them."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
