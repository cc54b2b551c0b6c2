"""Backups: an append-only snapshot table that is listed, restored from and expired."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cfgveil.functions.text import content_hash, file_stem, file_suffix
from cfgveil.session import join_lookup, materialized

# Fixed value: the format of a snapshot's timestamp. Its strings sort by time.
STAMP = "%Y%m%d_%H%M%S"
# Bytes of stored contents that a task sorts when many are restored at once.
RESTORED_BYTES = 32 << 20
CATALOG = ["backup_path", "original_path", "timestamp", "file_hash", "compressed", "size"]
LATEST = ["backup_path", "timestamp", "file_hash", "compressed", "size"]


def backup_path(path: Column, stamp: Column, digest: Column, directory: str, *, compressed: bool = True) -> Column:
    """Name of a snapshot; a compressed one has its suffix after a second dot."""
    ending = F.concat(F.lit("."), file_suffix(path), F.lit(".gz")) if compressed else file_suffix(path)
    return F.concat(F.lit(directory.rstrip("/") + "/"), file_stem(path), F.lit("_"), stamp, F.lit("_"), digest, ending)


def snapshot(df: DataFrame, directory: str, now: datetime, *, compressed: bool = True, path: str = "path", content: str = "content") -> DataFrame:
    """The originals as backup rows taken at `now`."""
    stamp = F.lit(f"{now:{STAMP}}")
    digest = content_hash(F.col(content), 8)
    return df.select(
        backup_path(F.col(path), stamp, digest, directory, compressed=compressed).alias("backup_path"),
        F.col(path).alias("original_path"),
        stamp.alias("timestamp"),
        digest.alias("file_hash"),
        F.lit(compressed).alias("compressed"),
        F.octet_length(content).cast("bigint").alias("size"),
        F.col(content).alias("content"),
        F.lit(f"{now:%Y-%m-%d}").alias("backup_date"),
    )


def append_backup(df: DataFrame, table: str, directory: str, now: datetime, *, compressed: bool = True) -> None:
    """Append snapshots to the table; the codec does the compressing."""
    rows = snapshot(df, directory, now, compressed=compressed)
    codec = "zstd" if compressed else "none"
    rows.write.mode("append").option("compression", codec).partitionBy("backup_date").parquet(table)


def read_catalog(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table)


def latest_backup(backups: DataFrame, date_prefix: str | None = None) -> DataFrame:
    """Newest snapshot per original; with a prefix, the newest of that day, month or year.

    A map-side aggregate over the narrow catalog columns: a file with very many snapshots
    is reduced before the shuffle, and no content travels.
    """
    chosen = backups if date_prefix is None else backups.filter(F.startswith("timestamp", F.lit(date_prefix)))
    newest = F.max(F.struct("timestamp", "backup_path", "file_hash", "compressed", "size")).alias("b")
    return chosen.groupBy("original_path").agg(newest).select("original_path", *[f"b.{c}" for c in LATEST])


def restore_files(requested: DataFrame, backups: DataFrame, date_prefix: str | None = None, *, path: str = "path") -> DataFrame:
    """Each requested path with its snapshot: path, backup_path, timestamp, restored[, content].

    The snapshot is chosen on the narrow catalog columns. Contents are then picked from
    the table through a size-checked lookup, by partition date where the table has one, so
    restoring a few files neither shuffles nor fully reads the stored contents. Many are
    sorted in parts of RESTORED_BYTES by the catalog's sizes, however few the session's partitions.
    """
    wanted = requested.select(F.col(path).alias("original_path")).distinct()
    mine = latest_backup(backups.join(wanted, "original_path", "left_semi"), date_prefix)
    found = wanted.join(mine, "original_path", "left").select(
        F.col("original_path").alias("path"), "backup_path", "timestamp", F.col("backup_path").isNotNull().alias("restored")
    )
    if "content" not in backups.columns:
        return found
    keys = ["backup_path"]
    hits = found.filter("restored")
    stored = backups.select("backup_path", "content")
    if "backup_date" in backups.columns:
        keys.append("backup_date")
        hits = hits.withColumn("backup_date", F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd"))
        stored = backups.select("backup_path", F.col("backup_date").cast("date").alias("backup_date"), "content")
    columns = ["path", "backup_path", "timestamp", "restored", "content"]
    total = backups.agg(F.sum("size")).first()[0] if "size" in backups.columns else None
    restored = join_lookup(stored, hits, keys, parts=-(-(total or 0) // RESTORED_BYTES)).select(*columns)
    missing = found.filter("not restored").withColumn("content", F.lit(None).cast(backups.schema["content"].dataType))
    return restored.unionByName(missing.select(*columns))


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, the root `/` of an absolute path included."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.transform(above, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _place(path: Column) -> Column:
    """A key whose order puts a folder right before all that lies below it: no path holds NUL."""
    return F.when(path == "/", F.lit("\0")).otherwise(F.concat(F.replace(path, F.lit("/"), F.lit("\0")), F.lit("\0")))


def restore_directory(directories: DataFrame, backups: DataFrame, *, directory: str = "directory") -> DataFrame:
    """Latest snapshot of every file below the requested folders: directory, original_path, backup_path, timestamp.

    A prefix join by one sort. Snapshots are reduced to the newest of each file first. Files and
    folders are then range-partitioned by place: the last folder before a file is either one
    that holds it or lies, as the file does, below those that do. So each file takes the
    requested folders above that last one (a chain no longer than its depth), of its own
    range or of one before, and keeps those above itself: rows are made for matches only, and
    a folder that holds most files is spread over as many ranges as these fill.
    """
    spark = backups.sparkSession
    wanted = directories.select(F.regexp_replace(directory, r"(.)/+\z", "$1").alias("directory")).where("directory is not null").distinct()
    above = wanted.select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
    chains = above.join(wanted.select(F.col("directory").alias("above")), "above").groupBy("directory").agg(F.collect_set("above").alias("chain"))
    newest = latest_backup(backups).where("original_path is not null")
    empty = F.lit(None)
    rows = chains.select(_place(F.col("directory")).alias("place"), F.lit(0).alias("kind"), "chain", empty.cast("string").alias("original_path"), empty.cast("string").alias("backup_path"), empty.cast("string").alias("timestamp")).unionByName(
        newest.select(_place(F.col("original_path")).alias("place"), F.lit(1).alias("kind"), empty.cast("array<string>").alias("chain"), "original_path", "backup_path", "timestamp")
    )
    # Written, so that ranges and what is carried between them come from one layout.
    laid = materialized(rows.repartitionByRange("place", "kind").withColumn("range", F.spark_partition_id()), "places")
    # One small row a range: the chain that is open at its beginning.
    last = laid.groupBy("range").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("place"))).alias("chain"))
    ends = sorted(last.collect(), key=lambda r: r["range"])
    open_, carried = None, []
    for r in ends:
        carried.append((r["range"], open_))
        open_ = r["chain"] if r["chain"] is not None else open_
    before = spark.createDataFrame(carried, "range int, carried array<string>")
    here = F.last("chain", ignorenulls=True).over(Window.partitionBy("range").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    files = laid.withColumn("here", here).where("kind = 1").join(F.broadcast(before), "range")
    path = F.col("original_path")
    holds = lambda d: (path == d) | F.startswith(path, F.when(d == "/", F.lit("/")).otherwise(F.concat(d, F.lit("/"))))
    return files.select(F.explode(F.filter(F.coalesce("here", "carried"), holds)).alias("directory"), "original_path", "backup_path", "timestamp")


def list_backups(backups: DataFrame, path: str | None = None) -> DataFrame:
    """Catalog rows, newest first, of one original or of all."""
    chosen = backups if path is None else backups.filter(F.col("original_path") == path)
    return chosen.select(*CATALOG).orderBy(F.desc("timestamp"), "backup_path")


def retained(backups: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """The rows a retention period keeps; zero or less keeps all.

    Timestamps are compared as strings, so the filter reaches the scan and no session
    time zone takes part.
    """
    return backups if retention_days <= 0 else backups.filter(F.col("timestamp") >= _cutoff(now, retention_days))


def expired(backups: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """The complement of `retained`."""
    return backups.filter(F.lit(False)) if retention_days <= 0 else backups.filter(F.col("timestamp") < _cutoff(now, retention_days))


def drop_expired(spark: SparkSession, table: str, now: datetime, retention_days: int) -> list[str]:
    """Remove the snapshots a retention period does not keep; returns the `backup_date` days that changed.

    Days before the first kept one go as whole partitions, without being read. Of that day
    itself the kept rows are written beside the table's partitions, which then change places
    by renames; a call that died is finished by the next one (where renames are atomic).
    Zero or fewer days keep all.
    """
    if retention_days <= 0:
        return []
    first = datetime.strptime(_cutoff(now, retention_days), STAMP).strftime("%Y-%m-%d")
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    part, kept, old = new_path(f"{table}/backup_date={first}"), new_path(f"{table}/_kept-{first}"), new_path(f"{table}/_old-{first}")
    fs = part.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(part):
        fs.rename(kept, part)
    fs.delete(old, True)
    rows = read_catalog(spark, table)
    day = F.col("backup_date").cast("string")
    days = sorted(r[0] for r in rows.where(day < first).select(day).distinct().collect())
    for gone in days:
        fs.delete(new_path(f"{table}/backup_date={gone}"), True)
    of_day = rows.where(day == first)
    if not expired(of_day, now, retention_days).isEmpty():
        retained(of_day, now, retention_days).drop("backup_date").write.mode("overwrite").option("compression", "zstd").parquet(kept.toString())
        fs.rename(part, old)
        fs.rename(kept, part)
        fs.delete(old, True)
        days.append(first)
    return days


def _cutoff(now: datetime, days: int) -> str:
    """The first whole second that is kept."""
    cut = now - timedelta(days=days)
    return f"{cut + timedelta(seconds=1) if cut.microsecond else cut:{STAMP}}"


def backup_stats(backups: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("size"), F.lit(0))
    return backups.agg(
        F.count(F.lit(1)).alias("total_backups"),
        size.alias("total_size"),
        F.round(size / 1048576.0, 2).alias("total_size_mb"),
        F.min("timestamp").alias("oldest_backup"),
        F.max("timestamp").alias("newest_backup"),
    )
