"""Run results, statistics and the security report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.functions.text import file_name
from cfgveil.operators.ranking import numbered
from cfgveil.session import materialized

GENERATOR = "cfgveil"
REPORT_VERSION = "1.0"


# Results ----------------------------------------------------------------------------


def results(sanitized: DataFrame, *, path: str = "path", backup: Column | None = None) -> DataFrame:
    """One result row per file, as written to JSON and CSV; a duration nobody measured is null."""
    have = set(sanitized.columns)
    return sanitized.select(
        F.col(path).alias("file"),
        "modified",
        "changes",
        "change_count",
        (F.col("error") if "error" in have else F.lit(None).cast("string")).alias("error"),
        (F.lit(None).cast("string") if backup is None else backup).alias("backup"),
        (F.col("duration") if "duration" in have else F.lit(None)).cast("double").alias("duration"),
    )


def results_csv(rows: DataFrame) -> DataFrame:
    return rows.select(
        file_name(F.col("file")).alias("File"),
        F.when(F.col("modified"), "Yes").otherwise("No").alias("Modified"),
        F.col("change_count").alias("Changes"),
        F.coalesce("error", F.lit("")).alias("Error"),
        F.coalesce("backup", F.lit("")).alias("Backup"),
        F.when(F.col("duration").isNotNull(), F.format_string("%.3f", "duration")).otherwise("").alias("Duration"),
    )


def results_json(rows: DataFrame) -> DataFrame:
    """One JSON document per file; missing error and backup stay as null fields."""
    fields = ["file", "modified", "changes", "change_count", "error", "backup", "duration"]
    return rows.select("file", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def with_errors(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Results plus error rows (path, error) for files that could not be processed."""
    failed = errors.select(
        F.col("path").alias("file"),
        F.lit(False).alias("modified"),
        F.array().cast("array<string>").alias("changes"),
        F.lit(0).alias("change_count"),
        "error",
        F.lit(None).cast("string").alias("backup"),
        F.lit(None).cast("double").alias("duration"),
    )
    return rows.unionByName(failed)


def run_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if("modified").alias("files_modified"),
        F.coalesce(F.sum("change_count"), F.lit(0)).alias("total_changes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def top_changed(rows: DataFrame, n: int = 5) -> DataFrame:
    """The modified files with most change messages; ties by path."""
    return rows.filter("modified").select("file", "change_count").orderBy(F.desc("change_count"), "file").limit(n)


def parse_change(message: Column) -> Column:
    """A change message as struct<type, count>: `Type: N replaced`; others count once."""
    number = F.regexp_extract(message, r"(\d+)\s+(?:replaced|checked)", 1)
    labelled = F.contains(message, F.lit(":"))
    return F.struct(
        F.when(labelled, F.trim(F.element_at(F.split(message, ":"), 1))).otherwise("unknown").alias("type"),
        F.when(labelled & (number != ""), number.cast("bigint")).otherwise(F.lit(1)).alias("count"),
    )


# Roll-ups ---------------------------------------------------------------------------


def with_name(sanitized: DataFrame) -> DataFrame:
    if "filename" in sanitized.columns:
        return sanitized
    return sanitized.withColumn("filename", file_name(F.col("path")))


def secrets_by_type(sanitized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: total count and number of distinct file names.

    Labels are few and hot; the distinct count is planned over (label, file name) first,
    so no task ever holds the files of one label.
    """
    return (
        with_name(sanitized)
        .select(*by, "filename", F.inline("findings"))
        .groupBy(*by, "label")
        .agg(F.sum("n").alias("total_count"), F.countDistinct("filename").alias("affected_files"))
    )


SKETCH_BITS = 12  # 4096 registers: a distinct count is off by 2 % (one standard error) or less


def label_sketches(sanitized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, label, total_count, files): as `secrets_by_type`, with a mergeable sketch of the file names.

    Sums and sketches of parts (a day, a folder) can be stored and added up by `merged_sketches`
    without going back to the findings; a sketch takes 4 KB at most, whatever it has counted.
    """
    found = with_name(sanitized).select(*by, "filename", F.inline("findings"))
    return found.groupBy(*by, "label").agg(F.sum("n").alias("total_count"), F.hll_sketch_agg("filename", SKETCH_BITS).alias("files"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, label, total_count, affected_files): stored parts added up. Totals are exact; the
    number of distinct file names is an estimate (see SKETCH_BITS), exact for few."""
    return sketches.groupBy(*by, "label").agg(
        F.sum("total_count").alias("total_count"), F.hll_sketch_estimate(F.hll_union_agg("files")).alias("affected_files")
    )


def file_secrets(findings: Column) -> Column:
    """Findings of one file as array<struct<label, n>>, summed per label, in order of appearance."""
    labels = F.array_distinct(F.transform(findings, lambda f: f["label"]))
    return F.transform(
        labels,
        lambda label: F.struct(
            label.alias("label"),
            F.aggregate(
                F.filter(findings, lambda f: f["label"] == label),
                F.lit(0).cast("bigint"),
                lambda total, f: total + f["n"],
            ).alias("n"),
        ),
    )


def file_details(sanitized: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """Per modified file: change count and counts per label. A row is a file, so nothing is shuffled."""
    return (
        with_name(sanitized)
        .filter(F.col("modified") & (F.col("change_count") > 0))
        .select(*keep, "filename", F.col("change_count").alias("changes"), file_secrets(F.col("findings")).alias("secrets"))
    )


def security_summary(sanitized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total secrets, files with secrets and distinct types, in one pass."""
    exploded = sanitized.select(*by, F.posexplode("findings").alias("pos", "f")).select(
        *by, (F.col("pos") == 0).alias("first"), "f.label", "f.n"
    )
    return exploded.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_secrets_found"),
        F.count_if("first").alias("files_containing_secrets"),
        F.countDistinct("label").alias("secret_types_detected"),
    )


PART = "struct<label:string,filename:string,n:bigint,files:bigint,with_secrets:bigint>"


def _part(*values: Column) -> Column:
    return F.struct(*values).cast(PART)


def security_report(sanitized: DataFrame, generated_at: str, *, archive: str = "archive", output: Column | None = None) -> DataFrame:
    """One row per archive: metadata, archive_info, security_summary and secrets_by_type.

    Everything in a row is bounded by the number of labels. The per-file part has no such
    bound and stays a table (`file_details`); `report_lines` renders the whole document.
    """
    # One row for the file itself and one for each finding, summed to (label, file), then to
    # (label), then to the archive: the results are read once and nothing is joined.
    found = with_name(sanitized).select(
        archive,
        F.inline(
            F.concat(
                F.array(_part(F.lit(None), F.lit(None), F.lit(0), F.lit(1), (F.col("modified") & (F.col("change_count") > 0)).cast("int"))),
                F.coalesce(F.transform("findings", lambda f: _part(f["label"], F.col("filename"), f["n"], F.lit(0), F.lit(0))), F.array().cast(f"array<{PART}>")),
            )
        ),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "files", "with_secrets")]
    labels = found.groupBy(archive, "label", "filename").agg(*sums).groupBy(archive, "label").agg(*sums, F.count("filename").alias("affected_files"))
    entry = F.struct((-F.col("n")).alias("o"), "label", F.col("n").alias("total_count"), "affected_files")
    files = labels.groupBy(archive).agg(
        F.sum("files").alias("files"),
        F.sum("with_secrets").alias("with_secrets"),
        F.sum("n").alias("total"),
        F.count("label").alias("types"),
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), entry))).alias("listed"),
    )
    listed = F.coalesce("listed", F.array().cast("array<struct<o:bigint,label:string,total_count:bigint,affected_files:bigint>>"))
    return files.select(
        archive,
        F.struct(
            F.lit(generated_at).alias("generated_at"),
            F.lit(GENERATOR).alias("generated_by"),
            F.lit(REPORT_VERSION).alias("report_version"),
        ).alias("report_metadata"),
        F.struct(
            F.col(archive).alias("original_archive"),
            (F.col(archive) if output is None else output).alias("sanitized_output"),
            F.col("files").alias("total_files_extracted"),
            F.col("with_secrets").alias("total_files_sanitized"),
        ).alias("archive_info"),
        F.struct(
            F.coalesce("total", F.lit(0)).alias("total_secrets_found"),
            F.col("with_secrets").alias("files_containing_secrets"),
            F.coalesce("types", F.lit(0)).cast("bigint").alias("secret_types_detected"),
        ).alias("security_summary"),
        F.transform(listed, lambda t: F.struct(t["label"].alias("label"), t["total_count"].alias("total_count"), t["affected_files"].alias("affected_files"))).alias("secrets_by_type"),
    )


# Rendering --------------------------------------------------------------------------

RULE_80, DASH_80 = "=" * 80, "-" * 80


def _json(value: Column) -> Column:
    """A value as a JSON literal."""
    packed = F.to_json(F.array(value))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def _most_first(secrets: Column) -> Column:
    """Secrets of a file by falling count; equal counts keep their order of appearance."""
    keyed = F.transform(secrets, lambda s, i: F.struct((-s["n"]).alias("o"), i.alias("i"), s["label"].alias("label"), s["n"].alias("n")))
    return F.array_sort(keyed)


# Each format states the text of the four parts of a document as columns: head and tail
# over a report row, one entry per type, one per file (`idx` of `total`). Fixed values:
# headings and layout of the three formats.
def _txt(part: str) -> Column:
    info, summary, meta = F.col("archive_info"), F.col("security_summary"), F.col("report_metadata")
    if part == "head":
        return _text(
            f"{RULE_80}\nNETWORK CONFIGURATION SANITIZATION SECURITY REPORT\n{RULE_80}\n\nGenerated: ", meta["generated_at"],
            "\nTool: ", meta["generated_by"], f"\n\n{DASH_80}\nARCHIVE INFORMATION\n{DASH_80}\nOriginal Archive: ",
            info["original_archive"], "\nSanitized Output: ", info["sanitized_output"], "\nTotal Files: ",
            info["total_files_extracted"], "\nFiles Sanitized: ", info["total_files_sanitized"],
            f"\n\n{DASH_80}\nSECURITY SUMMARY\n{DASH_80}\nTotal Secrets Found: ", summary["total_secrets_found"],
            "\nFiles With Secrets: ", summary["files_containing_secrets"], "\nSecret Types: ",
            summary["secret_types_detected"], "\n",
            F.when(F.size("secrets_by_type") > 0, f"\n{DASH_80}\nSECRETS BY TYPE\n{DASH_80}").otherwise(""),
        )
    if part == "type":
        return _text("\n", F.col("label"), ":\n  Count: ", F.col("total_count"), "\n  Affected Files: ", F.col("affected_files"))
    if part == "files":
        return F.lit(f"\n{DASH_80}\nMODIFIED FILES\n{DASH_80}")
    if part == "file":
        each = F.transform(_most_first(F.col("secrets")), lambda s: _text("     - ", s["label"], ": ", s["n"]))
        return _text(
            "\n", F.col("idx"), ". ", F.col("filename"), "\n   Total Changes: ", F.col("changes"),
            F.when(F.size("secrets") > 0, _text("\n   Secrets Found:\n", _joined(each, "\n"))).otherwise(""),
        )
    return F.lit(f"\n{RULE_80}\nEND OF REPORT\n{RULE_80}")


def _md(part: str) -> Column:
    info, summary, meta = F.col("archive_info"), F.col("security_summary"), F.col("report_metadata")
    if part == "head":
        return _text(
            "# Network Configuration Sanitization Security Report\n\n## Report Metadata\n\n- **Generated:** ",
            meta["generated_at"], "\n- **Tool:** ", meta["generated_by"], "\n- **Version:** ", meta["report_version"],
            "\n\n## Archive Information\n\n- **Original Archive:** `", info["original_archive"],
            "`\n- **Sanitized Output:** `", info["sanitized_output"], "`\n- **Total Files Extracted:** ",
            info["total_files_extracted"], "\n- **Files Sanitized:** ", info["total_files_sanitized"],
            "\n\n## Security Summary\n\n- **Total Secrets Found:** ", summary["total_secrets_found"],
            "\n- **Files Containing Secrets:** ", summary["files_containing_secrets"],
            "\n- **Secret Types Detected:** ", summary["secret_types_detected"], "\n",
            F.when(
                F.size("secrets_by_type") > 0,
                "\n## Secrets by Type\n\n| Secret Type | Total Count | Affected Files |\n"
                "|-------------|-------------|----------------|",
            ).otherwise(""),
        )
    if part == "type":
        return _text("| ", F.col("label"), " | ", F.col("total_count"), " | ", F.col("affected_files"), " |")
    if part == "files":
        return F.lit("\n## Modified Files\n")
    if part == "file":
        each = F.transform(_most_first(F.col("secrets")), lambda s: _text("- `", s["label"], "`: ", s["n"]))
        return _text(
            "### ", F.col("idx"), ". ", F.col("filename"), "\n\n**Total Changes:** ", F.col("changes"), "\n",
            F.when(F.size("secrets") > 0, _text("\n**Secrets Found:**\n\n", _joined(each, "\n"), "\n")).otherwise(""),
        )
    return _text("---\n\n*Report generated by ", meta["generated_by"], "*")


def _js(part: str) -> Column:
    info, summary, meta = F.col("archive_info"), F.col("security_summary"), F.col("report_metadata")
    comma = F.when(F.col("idx") < F.col("total"), ",").otherwise("") if part in ("type", "file") else None

    def obj(name: str, struct: Column, fields: Sequence[str]) -> Column:
        lines: list = [f'  "{name}": {{\n']
        for i, f in enumerate(fields):
            lines += [f'    "{f}": ', _json(struct[f]), ",\n" if i + 1 < len(fields) else "\n"]
        return _text(*lines, "  },\n")

    if part == "head":
        return _text(
            "{\n",
            obj("report_metadata", meta, ["generated_at", "generated_by", "report_version"]),
            obj("archive_info", info, ["original_archive", "sanitized_output", "total_files_extracted", "total_files_sanitized"]),
            obj("security_summary", summary, ["total_secrets_found", "files_containing_secrets", "secret_types_detected"]),
            '  "secrets_by_type": {',
        )
    if part == "type":
        return _text(
            "    ", _json(F.col("label")), ': {\n      "total_count": ', F.col("total_count"),
            ',\n      "affected_files": ', F.col("affected_files"), "\n    }", comma,
        )
    if part == "files":
        return F.lit('  },\n  "file_details": [')
    if part == "file":
        each = F.transform(F.col("secrets"), lambda s: _text("        ", _json(s["label"]), ": ", s["n"]))
        return _text(
            '    {\n      "filename": ', _json(F.col("filename")), ',\n      "changes": ', F.col("changes"),
            ',\n      "secrets_by_type": {\n', _joined(each, ",\n"), "\n      }\n    }", comma,
        )
    return F.lit("  ]\n}")


FORMATS = {"txt": _txt, "md": _md, "json": _js}


def report_lines(sanitized: DataFrame, generated_at: str, fmt: str, *, archive: str = "archive", output: Column | None = None) -> DataFrame:
    """The report of every archive as ordered text rows: archive, section, idx, line.

    Rows in the order (archive, section, idx) spell the document. Files are numbered by
    falling change count with `numbered`, so an archive with any number of files is
    rendered by many tasks.
    """
    part = FORMATS[fmt]
    # Rows bounded by the number of labels; written once for the four sections made of them.
    report = materialized(security_report(sanitized, generated_at, archive=archive, output=output), "report")
    files = numbered(
        file_details(sanitized, [archive, "path"]), [archive], [F.desc("changes"), F.asc("path")]
    )
    types = report.select(
        archive, F.size("secrets_by_type").alias("total"), F.posexplode("secrets_by_type").alias("pos", "t")
    ).select(archive, (F.col("pos") + 1).cast("bigint").alias("idx"), "total", "t.*")
    has_files = F.lit(True) if fmt == "json" else F.col("archive_info.total_files_sanitized") > 0
    fixed = [(0, part("head")), (2, F.when(has_files, part("files"))), (4, part("tail"))]
    rows = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(0).cast("bigint").alias("idx"), line.alias("line")) for k, line in fixed])
    once = report.select(archive, F.inline(rows)).where("line is not null")
    types = types.select(archive, F.lit(1).alias("section"), "idx", part("type").alias("line"))
    return once.unionByName(types).unionByName(files.select(archive, F.lit(3).alias("section"), "idx", part("file").alias("line")))
