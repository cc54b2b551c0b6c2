"""File scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.functions.text import decode_text, file_name
from cfgveil.operators.archives import ARCHIVE_SUFFIXES, MAX_CELL
from cfgveil.sources.stores import dealt_files, is_folder, list_folder, reachable, read_bodies

# The default file patterns.
FILE_PATTERNS = ("*.txt", "*.conf", "*.config", "*.cfg")
TOO_LONG = "File exceeds the size limit of one cell"


def variants(patterns: Sequence[str]) -> list[str]:
    """The patterns; `*.ext` also in upper, lower and title case."""
    wanted: list[str] = []
    for pattern in patterns:
        wanted.append(pattern)
        if pattern.startswith("*."):
            extension = pattern[2:]
            wanted += [f"*.{v}" for v in (extension.upper(), extension.lower(), extension.title())]
    return list(dict.fromkeys(wanted))


def glob_variants(patterns: Sequence[str]) -> str:
    """One brace glob of the patterns and their variants."""
    return "{" + ",".join(variants(patterns)) + "}"


def glob_regex(glob: str) -> str:
    """A glob as a Java pattern, read as the scans read it: `*`, `?`, `[..]`, `[^..]`, `{a,b}`, backslash escapes."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2) if c == "[" else -1
        if c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        elif close > 0:
            body = glob[at + 1 : close]
            inside = body[1:] if body[0] in "^!" else body
            out += ("[^" if inside != body else "[") + re.sub(r"([\[\]\\&^])", r"\\\1", inside) + "]"
            at = close
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "{" or c == "}" and depth:
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        else:
            out += "|" if c == "," and depth else re.escape(c)
        at += 1
    return out


def glob_pattern(patterns: Sequence[str]) -> str:
    """A Java pattern for the names that any of the patterns or their variants selects."""
    return r"(?s)\A(?:" + "|".join(glob_regex(g) for g in variants(patterns)) + r")\z"


def _binary(spark: SparkSession, root: str, patterns: Sequence[str], recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob_variants(patterns))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )


def longest_file(spark: SparkSession) -> int:
    """The longest file that is read into a cell."""
    return min(MAX_CELL, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))


def list_files(spark: SparkSession, root: str, patterns: Sequence[str] = FILE_PATTERNS, *, recursive: bool = True) -> DataFrame:
    """path, filename, length of the matching files; contents are never read."""
    return _binary(spark, root, patterns, recursive).select("path", file_name(F.col("path")).alias("filename"), "length")


def found_files(spark: SparkSession, root: str, patterns: Sequence[str] = FILE_PATTERNS) -> DataFrame | None:
    """(path, length) of the matching files below one folder, listed by the executors; None where these can't list."""
    if not is_folder(spark, root):
        return None
    return list_folder(spark, root).where(file_name(F.col("path")).rlike(glob_pattern(patterns)))


def scan_configs(
    spark: SparkSession,
    root: str,
    patterns: Sequence[str] = FILE_PATTERNS,
    *,
    recursive: bool = True,
    normalize_newlines: bool = True,
    include_empty: bool = True,
    manifest: DataFrame | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """path, filename, content, error of the matching configuration files, one row per file.

    A file too long for one cell has null content and an error. A folder that the executors
    can reach is listed and read by them, however many files it holds; `found` is such a listing, if
    it was made before (`found_files`). Else (a glob for a root, a store that only Spark reads,
    one level alone) Spark lists on the driver. Its readers skip files of length zero;
    `include_empty` adds them, from the rows of length zero in a `manifest` (path as the
    scan gives it, length; only matching files), which must be given where the executors can't list.
    """
    limit = longest_file(spark)
    text = decode_text(F.col("content"), normalize_newlines=normalize_newlines)
    name, none = file_name(F.col("path")).alias("filename"), F.lit(None).cast("string")
    if found is None and recursive and manifest is None:
        found = found_files(spark, root, patterns)
    if found is not None:
        listed = dealt_files(found if include_empty else found.where("length > 0"))
        error = F.when(F.col("content").isNull(), F.lit(TOO_LONG)).alias("error")
        return read_bodies(listed, root, limit).select("path", name, text.alias("content"), error)
    files = _binary(spark, root, patterns, recursive)
    # The filters stand on the relation itself: it must not open a file it cannot hold.
    read = files.filter(F.col("length") <= limit).select("path", name, text.alias("content"), none.alias("error"))
    long = files.filter(F.col("length") > limit).select("path", name, none.alias("content"), F.lit(TOO_LONG).alias("error"))
    found = read.unionByName(long)
    if not include_empty:
        return found
    if manifest is not None:
        empty = manifest.filter("length = 0").select("path")
    elif reachable(spark, root):
        matches = file_name(F.col("path")).rlike(glob_pattern(patterns))
        empty = list_folder(spark, root, recursive=recursive).where((F.col("length") == 0) & matches).select("path")
    else:
        raise ValueError(f"the executors can't list {root}: give a manifest, or include_empty=False")
    return found.unionByName(empty.select("path", name, F.lit("").alias("content"), none.alias("error")))


def scan_archives(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """path, length, content of the archives below a folder, found by suffix.

    An archive too long for one cell has null content; `expand_archives` gives it an error row.
    """
    patterns = [f"*{suffix}" for suffix in ARCHIVE_SUFFIXES]
    files, limit = _binary(spark, root, patterns, recursive), longest_file(spark)
    # The filters stand on the relation itself: it must not open a file it cannot hold.
    read = files.filter(F.col("length") <= limit).select("path", "length", "content")
    return read.unionByName(files.filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content")))


def missing_inputs(requested: DataFrame, found: DataFrame, *, path: str = "path") -> DataFrame:
    """Requested paths that were not found, as error rows (path, error)."""
    absent = requested.select(path).distinct().join(found.select(path), path, "left_anti")
    return absent.select(F.col(path).alias("path"), F.concat(F.lit("File not found: "), F.col(path)).alias("error"))


def file_list(files: DataFrame, *, path: str = "path") -> DataFrame:
    """Distinct paths in order."""
    return files.select(path).distinct().orderBy(path)
