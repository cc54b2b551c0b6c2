"""Streams of configuration files and log lines. Sanitizing is stateless, so the batch operators run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cfgveil.functions.logs import redact_log
from cfgveil.functions.text import decode_text, file_name
from cfgveil.operators.report import file_secrets, with_name
from cfgveil.operators.sanitize import sanitize
from cfgveil.sources.files import FILE_PATTERNS, TOO_LONG, glob_pattern, glob_variants, longest_file
from cfgveil.sources.stores import arriving_files, is_folder, read_bodies

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def config_stream(spark: SparkSession, folder: str, patterns=FILE_PATTERNS, *, max_length: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder into which configuration files are dropped: path, filename, content, error.

    A file longer than one cell, `spark.sql.sources.binaryFile.maxLength` or `max_length`
    is never opened: it becomes a row with an error and no content, and the stream goes on.
    One folder is listed by the executors on every trigger (`arriving_files`); with `files_per_batch`, and where they can't list
    it, by Spark's file source, on the driver. A checkpoint of the one doesn't serve the other.
    """
    limit = longest_file(spark)
    limit = limit if max_length is None else min(limit, max_length)
    name, none = file_name(F.col("path")).alias("filename"), F.lit(None).cast("string")
    here = is_folder(spark, folder)
    if here and not files_per_batch:
        # As Spark's file source, which meets files of length zero and gives no rows for them.
        return _read_whole(arriving_files(spark, folder, glob_pattern(patterns)).where("length > 0"), folder, limit)
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob_variants(patterns))
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    files = reader.load(folder)
    if here:
        return _read_whole(files.select("path", "length"), folder, limit)
    # The filters stand on the relation itself: it must not open a file it cannot hold.
    read = files.filter(F.col("length") <= limit).select("path", name, decode_text(F.col("content")).alias("content"), none.alias("error"))
    return read.unionByName(files.filter(F.col("length") > limit).select("path", name, none.alias("content"), F.lit(TOO_LONG).alias("error")))


def _read_whole(files: DataFrame, folder: str, limit: int) -> DataFrame:
    """One source, whose files the executors open, dealt anew: Spark gives a task but 32 small files."""
    dealt = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    error = F.when(F.col("content").isNull(), F.lit(TOO_LONG)).alias("error")
    return read_bodies(dealt, folder, limit).select("path", file_name(F.col("path")).alias("filename"), decode_text(F.col("content")).alias("content"), error)


def sanitize_stream(configs: DataFrame, **options) -> DataFrame:
    return sanitize(configs, **options)


def redact_log_stream(logs: DataFrame, *, message: str = "message") -> DataFrame:
    return logs.withColumn(message, redact_log(F.col(message)))


def findings_rollup(sanitized: DataFrame) -> DataFrame:
    """(filename, label, n): what each arriving file adds to the totals; no state is held."""
    return with_name(sanitized).select("filename", F.inline(file_secrets(F.col("findings"))))


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, add it to a parquet table and read that table.

    Each batch is written once, under its epoch, so a repeated batch overwrites only itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    spark = stream.sparkSession
    write(spark.createDataFrame([], stream.schema), -1)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def run_with_errors(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Process what has arrived; (rows without an `error`, dead letters: rows with one) of the table at `out`.

    Each batch is written once, under its epoch and by its outcome, so a repeated batch
    overwrites only itself and dead letters can be read, and repaired, for themselves.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(f"{out}/epoch={epoch}")

    spark = stream.sparkSession
    write(spark.createDataFrame([], stream.schema), -1)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", LongType()), StructField("failed", BooleanType())])).parquet(out)
    return rows.where("not failed").drop("epoch", "failed"), rows.where("failed").drop("epoch", "failed")


def run_rollup(added: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what has arrived; returns total and number of distinct file names per label, as `secrets_by_type`.

    Each batch is written once, as narrow rows below `checkpoint`; a second stream over these
    holds in keyed state which file names a label has met (Spark's own deduplication, no call
    per key), so equal names of different folders or batches count once and a batch costs what
    it brings: it adds its sums to the totals of the epoch before, a row for each label, and
    writes them under its own epoch. A repeated batch finds its rows and its new names
    written, adds what its source brings besides, and starts from the same totals. Nothing arrived: no rows. State is held on the
    executors' disks where the session names the RocksDB state store.
    """
    spark = added.sparkSession
    schema = "label string, total_count bigint, affected_files bigint"
    rows_schema, new_schema = "label string, filename string, n bigint", "epoch bigint, label string, new bigint"
    rows, new = f"{checkpoint}/rows", f"{checkpoint}/new"

    def write(batch: DataFrame, epoch: int) -> None:
        here, first_met = f"{rows}/epoch={epoch}", f"{new}/{epoch}"

        def met(names: DataFrame, number: int) -> None:
            names.groupBy("epoch", "label").agg(F.count(F.lit(1)).alias("new")).coalesce(1).write.mode("overwrite").parquet(f"{first_met}/epoch={number}")

        arrivals = batch.select("label", "filename", "n")
        if epoch not in _epochs(spark, rows):
            arrivals.write.mode("overwrite").parquet(here)
        else:  # what has come since the first attempt, if the source lists anew
            arrivals.exceptAll(spark.read.schema(rows_schema).parquet(here)).write.mode("append").parquet(here)
        spark._jvm.org.apache.hadoop.fs.Path(new).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{new}/{epoch - 1}"), True)
        _drop(spark, rows, [e for e in _epochs(spark, rows) if e < epoch])
        arrived = spark.readStream.schema(f"{rows_schema}, epoch bigint").parquet(rows)
        first = arrived.select("epoch", "label", "filename").dropDuplicates(["label", "filename"]).select("epoch", "label")
        first.writeStream.foreachBatch(met).option("checkpointLocation", f"{checkpoint}/names").trigger(availableNow=True).start().awaitTermination()
        sums = spark.read.schema(rows_schema).parquet(here).groupBy("label").agg(F.sum("n").alias("total_count"), F.lit(0).cast("bigint").alias("affected_files"))
        for done in _epochs(spark, first_met):
            names = spark.read.schema(new_schema).parquet(f"{first_met}/epoch={done}").where(F.col("epoch") == epoch)
            sums = sums.unionByName(names.select("label", F.lit(0).cast("bigint").alias("total_count"), F.col("new").alias("affected_files")))
        old = [e for e in _epochs(spark, out) if e < epoch]
        if old:
            sums = sums.unionByName(spark.read.schema(schema).parquet(f"{out}/epoch={old[-1]}"))
        totals = sums.groupBy("label").agg(F.sum("total_count").alias("total_count"), F.sum("affected_files").alias("affected_files"))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        _drop(spark, out, old[:-1])  # the epoch before stays, for a repeat of this one

    query = added.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = _epochs(spark, out)
    return spark.read.schema(schema).parquet(f"{out}/epoch={done[-1]}") if done else spark.createDataFrame([], schema)


def _drop(spark: SparkSession, out: str, epochs: list[int]) -> None:
    for gone in epochs:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/epoch={gone}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _epochs(spark: SparkSession, out: str) -> list[int]:
    """Epochs that are written whole, in order: two at most are kept."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and store.exists(path(f"{out}/{n}/_SUCCESS")))
