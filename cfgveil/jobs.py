"""End-to-end jobs: a folder of files, a folder of archives, a restore.

Each job writes its rewritten texts once and derives results and reports from what it
wrote, so the rules run once per text. Tables that operators write for themselves are gone at its end.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.functions.text import file_name, sanitized_name
from cfgveil.operators import archives as arc
from cfgveil.operators import backups as bak
from cfgveil.operators import report as rep
from cfgveil.operators.sanitize import sanitize
from cfgveil.packs import BUILTIN
from cfgveil.rules import RulePack
from cfgveil.session import scratch
from cfgveil.sinks import files as sinks
from cfgveil.sources import files as src

NO_PACK = RulePack("none", ())
RESULT_COLUMNS = ["modified", "changes", "change_count", "findings"]


def sanitize_folder(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    pack: RulePack = NO_PACK,
    builtin: RulePack = BUILTIN,
    patterns: Sequence[str] = src.FILE_PATTERNS,
    recursive: bool = True,
    include_empty: bool = True,
    requested: DataFrame | None = None,
    backup_table: str | None = None,
    backup_dir: str = ".backups",
    now: datetime | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Sanitize the configuration files below `root`; returns one result row per file.

    Writes `<out>/texts` (path, content, result columns) and appends the originals to
    `backup_table`. `requested` paths that are not there, and files too long for one cell, become error rows. A dry run
    writes nothing and returns the same results.
    """
    with nullcontext() if dry_run else scratch(spark):
        found = src.found_files(spark, root, patterns) if recursive else None
        configs = src.scan_configs(spark, root, patterns, recursive=recursive, include_empty=include_empty, found=found)
        backup = None
        if backup_table and not dry_run:
            taken = now or datetime.now()
            bak.append_backup(configs.filter("error IS NULL"), backup_table, backup_dir, taken)
            # What was saved is what is sanitized, whatever happens to the folder meanwhile.
            mine = (F.col("timestamp") == f"{taken:{bak.STAMP}}") & (F.col("backup_date").cast("string") == f"{taken:%Y-%m-%d}")
            path, none = F.col("original_path").alias("path"), F.lit(None).cast("string")
            saved = bak.read_catalog(spark, backup_table).filter(mine).select(path, file_name(path).alias("filename"), "content", none.alias("error"), "backup_path")
            configs = saved.unionByName(configs.filter("error IS NOT NULL").withColumn("backup_path", none))
            backup = F.col("backup_path")
        done = sanitize(configs, builtin=builtin, custom=pack)
        if not dry_run:
            kept = ["path", "filename", "error", *(["backup_path"] if backup is not None else []), *RESULT_COLUMNS]
            done.select(*kept, F.col("sanitized").alias("content")).write.parquet(f"{out}/texts")
            done = spark.read.parquet(f"{out}/texts")
    rows = rep.results(done, backup=backup)
    if requested is None:
        return rows
    # A dry run has written nothing that could be read again: what was listed tells the paths without the rules.
    known = done if found is None or not dry_run else found if include_empty else found.where("length > 0")
    return rep.with_errors(rows, src.missing_inputs(requested, known))


def _selected(member: Column, patterns: Sequence[str] | None) -> Column:
    """Which members are rewritten: by the configuration-file test, or by file patterns."""
    if patterns is None:
        return arc.is_config_file(member)
    return file_name(member).rlike(src.glob_pattern(patterns))


def sanitize_archive_folder(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    fmt: str = "folder",
    pack: RulePack = NO_PACK,
    builtin: RulePack = BUILTIN,
    patterns: Sequence[str] | None = None,
    generated_at: str | None = None,
    reports: Sequence[str] = ("json", "txt", "md"),
) -> DataFrame:
    """Sanitize the members of every archive below `root`; returns one row per archive.

    Writes `<out>/members` (every member, changed or not), then either reports under
    `<out>/reports/<format>` (`fmt="folder"`) or the packed archives under
    `<out>/archives`. Members are spread over the cluster after expansion, so one large
    archive does not keep its members in one task.
    """
    with scratch(spark):
        opened = arc.expand_archives(src.scan_archives(spark, root))
        members = opened.repartition("archive", "member")
        done = arc.sanitize_members(members, builtin=builtin, custom=pack, select=lambda m: _selected(m, patterns))
        kept = ["archive", "member", "size", "compressed_size", "encrypted", "error", "is_config", *RESULT_COLUMNS]
        done.select(*kept, F.col("output").alias("content")).write.parquet(f"{out}/members")
        written = spark.read.parquet(f"{out}/members")
        if fmt == "folder":
            when = generated_at or datetime.now().isoformat()
            files = written.filter("is_config").withColumns({"path": F.col("member"), "filename": file_name(F.col("member"))})
            for report in reports:
                sinks.write_report(rep.report_lines(files, when, report), f"{out}/reports/{report}")
        else:
            packed = arc.repack_archives(written, fmt)
            one = sanitized_name(F.col("archive"), extension=f".{fmt}")
            each = sanitized_name(F.col("archive"), extension=F.concat(F.lit("_"), F.col("volume").cast("string"), F.lit(f".{fmt}")))
            named = packed.withColumn("output_path", F.when(F.col("volumes") > 1, each).otherwise(one))
            sinks.write_archives(named, f"{out}/archives")
    return arc.archive_result(written)


def restore(
    spark: SparkSession, backup_table: str, out: str, *, files: DataFrame | None = None, directories: DataFrame | None = None,
    date_prefix: str | None = None,
) -> DataFrame:
    """Write the latest snapshots of files (path) or of whole directories (directory) to `out`."""
    with scratch(spark):
        catalog = bak.read_catalog(spark, backup_table)
        if files is not None:
            chosen = bak.restore_files(files, catalog, date_prefix)
        else:
            below = bak.restore_directory(directories, catalog).select("original_path").distinct()
            chosen = bak.restore_files(below.withColumnRenamed("original_path", "path"), catalog)
        chosen.write.parquet(out)
    return spark.read.parquet(out).select("path", "backup_path", "timestamp", "restored")
