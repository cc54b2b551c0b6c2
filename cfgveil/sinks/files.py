"""Sinks. Originals are never overwritten in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.functions.text import file_name, relative_path
from cfgveil.operators.report import results_csv, run_stats
from cfgveil.sources.stores import write_bodies


def write_sanitized(sanitized: DataFrame, out: str, *, partition_by: Sequence[str] = (), fmt: str = "parquet", only_modified: bool = False) -> None:
    """Sanitized texts as a table (path, content, modified) or as text files per partition."""
    rows = sanitized.filter("modified") if only_modified else sanitized
    if fmt == "text":
        rows.select(*partition_by, F.col("sanitized").alias("value")).write.partitionBy(*partition_by).text(out)
        return
    chosen = rows.select("path", F.col("sanitized").alias("content"), "modified", "changes", *partition_by)
    chosen.write.format(fmt).partitionBy(*partition_by).save(out)


def write_results_json(rows: DataFrame, out: str, *, stats_out: str | None = None) -> None:
    """Results as JSON lines, and the run statistics beside them if asked. Pass written results for both."""
    rows.write.option("ignoreNullFields", "false").json(out)
    if stats_out:
        run_stats(rows).write.json(stats_out)


def write_results_csv(rows: DataFrame, out: str) -> None:
    results_csv(rows).write.option("header", "true").csv(out)


def write_report(lines: DataFrame, out: str, *, archive: str = "archive") -> None:
    """Report lines as text files per archive; part files in name order spell the document."""
    keys = [archive, "section", "idx"]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select(archive, F.col("line").alias("value")).write.partitionBy(archive).text(out)


def write_archives(archives: DataFrame, out: str) -> None:
    """Packed archives as a table (archive, volume, volumes, content)."""
    archives.write.parquet(out)


def write_files(sanitized: DataFrame, out: str, *, root: str = "", column: str = "sanitized") -> DataFrame:
    """Every text as a file of its own below `out`, under its path below `root` (its name alone without a root).

    Returns (path, length) of the files written; the executors write them.
    """
    name = relative_path(F.col("path"), root) if root else file_name(F.col("path"))
    return write_bodies(sanitized.select(name.alias("name"), F.encode(column, "UTF-8").alias("body")), out)
