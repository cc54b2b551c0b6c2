"""Archives: identify, expand, sanitize members and pack them again."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import sys
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.functions.text import decode_text, file_name
from cfgveil.operators.chain import pinned
from cfgveil.operators.ranking import numbered
from cfgveil.operators.sanitize import sanitize
from cfgveil.session import join_lookup, materialized

# The member functions below travel to the workers by value, so that these need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Archive suffixes in the order they are tried.
ARCHIVE_SUFFIXES = {
    ".zip": "zip",
    ".7z": "7zip",
    ".rar": "rar",
    ".tar": "tar",
    ".tar.gz": "tar",
    ".tgz": "tar",
    ".tar.bz2": "tar",
    ".tbz2": "tar",
    ".tar.xz": "tar",
    ".txz": "tar",
    ".gz": "gzip",
    ".bz2": "bzip2",
    ".xz": "xz",
}
# Leading bytes, in hex, tried in this order around the tar mark.
MAGIC_BEFORE_TAR = {"504B": "zip", "377ABCAF271C": "7zip", "52617221": "rar"}
MAGIC_AFTER_TAR = {"1F8B": "gzip", "425A68": "bzip2", "FD377A585A00": "xz"}
# What makes a member a configuration file.
CONFIG_SUFFIXES = (".txt", ".conf", ".config", ".cfg", ".Config", ".ios", ".nx", ".eos", ".xml")
CONFIG_WORDS = ("running", "startup", "config", "conf", "show run", "show config", "cfg")

EXPANDABLE = ("zip", "tar", "gzip", "bzip2", "xz")
MAX_CELL = 2_000_000_000
TOO_LARGE = "member exceeds the size limit of one cell"
MEMBER_SCHEMA = (
    "archive string, member string, size bigint, compressed_size bigint, encrypted boolean, "
    "content binary, error string"
)
BATCH_BYTES = 32 << 20
VOLUME_BYTES = 256 << 20


def is_config_file(name: Column) -> Column:
    """Is this member a configuration file, by suffix (case-sensitive) or by a word in its path?"""
    by_suffix = F.lit(False)
    for suffix in CONFIG_SUFFIXES:
        by_suffix = by_suffix | F.endswith(name, F.lit(suffix))
    low, by_word = F.lower(name), F.lit(False)
    for word in CONFIG_WORDS:
        by_word = by_word | F.contains(low, F.lit(word))
    return by_suffix | by_word


def archive_type(path: Column, content: Column | None = None) -> Column:
    """The archive type by suffix, else by leading bytes, else null."""
    low = F.lower(file_name(path))
    kind = None
    for suffix, name in ARCHIVE_SUFFIXES.items():
        test = F.endswith(low, F.lit(suffix))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    if content is not None:
        head = F.hex(F.substring(content, 1, 8))
        for magic, name in MAGIC_BEFORE_TAR.items():
            kind = kind.when(F.startswith(head, F.lit(magic)), name)
        kind = kind.when(F.contains(F.decode(F.substring(content, 9, 512), "ISO-8859-1"), F.lit("ustar")), "tar")
        for magic, name in MAGIC_AFTER_TAR.items():
            kind = kind.when(F.startswith(head, F.lit(magic)), name)
    return kind


def _zip_members(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            locked = bool(info.flag_bits & 0x1)
            body, error = None, None
            if locked:
                error = "encrypted member"
            elif info.file_size > MAX_CELL:
                error = TOO_LARGE
            else:
                try:
                    body = archive.read(info)
                except Exception as problem:  # noqa: BLE001 - a bad member must not end the archive
                    error = f"unreadable member: {problem}"
            yield info.filename, info.file_size, info.compress_size, locked, body, error


def _tar_members(data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
        for info in archive:
            if info.isfile() and info.size > MAX_CELL:
                yield info.name, info.size, None, False, None, TOO_LARGE
            elif info.isfile():
                yield info.name, info.size, None, False, archive.extractfile(info).read(), None


INFLATE = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}


def _members(name: str, kind: str, data: bytes) -> Iterator[tuple]:
    if kind == "zip":
        yield from _zip_members(data)
    elif kind == "tar":
        yield from _tar_members(data)
    else:
        stem = name.rsplit("/", 1)[-1]
        stem = stem[: stem.rfind(".")] if stem.rfind(".") > 0 else stem
        with INFLATE[kind](io.BytesIO(data)) as source:
            body = source.read(MAX_CELL + 1)
        if len(body) > MAX_CELL:
            yield stem, None, len(data), False, None, TOO_LARGE
        else:
            yield stem, len(body), len(data), False, body, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [f.split()[0] for f in MEMBER_SCHEMA.split(", ")]
    types = {"size": "Int64", "compressed_size": "Int64", "encrypted": "boolean"}
    return pd.DataFrame(rows, columns=columns).astype(types)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for batch in batches:
        for path, kind, refused, data in zip(batch["path"], batch["kind"], batch["refused"], batch["content"], strict=True):
            if refused is not None:
                rows.append((path, None, None, None, None, None, refused))
                continue
            try:
                for member in _members(path, kind, data):
                    rows.append((path, *member))
                    held += len(member[4] or b"")
                    if held >= BATCH_BYTES:
                        yield _frame(rows)
                        rows, held = [], 0
            except Exception as problem:  # noqa: BLE001 - a broken archive is an error row
                rows.append((path, None, None, None, None, None, f"Failed to extract archive: {problem}"))
    if rows:
        yield _frame(rows)


def expand_archives(archives: DataFrame, *, max_bytes: int = MAX_CELL) -> DataFrame:
    """Archive rows (path, content[, length]) to member rows; directories are left out.

    Archives that cannot be opened (unknown or unsupported type, too large for one cell,
    as those that come with a length but without content, broken) and members that cannot be read become rows with an error. Members leave the
    Python worker in batches of bounded size. Follow with a repartition by member when
    few archives hold most of the data.
    """
    size = F.col("length") if "length" in archives.columns else F.octet_length("content")
    kind = {"length": size, "kind": archive_type(F.col("path"), F.col("content"))}
    typed = pinned(archives, ["path", "content"], kind)
    fits = F.coalesce(F.col("length") <= max_bytes, F.lit(False)) & F.col("content").isNotNull()
    refused = (
        F.when(F.col("kind").isNull(), "Unsupported archive format")
        .when(~fits, "Archive exceeds the size limit of one cell")
        .when(~F.col("kind").isin(*EXPANDABLE), F.concat(F.lit("Extraction not supported for "), F.col("kind")))
    )
    able = F.when(refused.isNull(), F.col("content"))  # what can't be opened doesn't travel
    return typed.select("path", "kind", refused.alias("refused"), able.alias("content")).mapInPandas(_expand, MEMBER_SCHEMA)


def _pack(kind: str, members: pd.DataFrame | Iterator[pd.DataFrame]) -> bytes:
    """An archive of members, given as one frame or as batches."""
    frames = [members] if isinstance(members, pd.DataFrame) else members
    bodies = (x for frame in frames for x in zip(frame["member"], frame["content"], strict=True))
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
            for name, body in bodies:
                archive.writestr(zipfile.ZipInfo(name), bytes(body), zipfile.ZIP_DEFLATED, 6)
        return out.getvalue()
    mode = {"tar": "w", "tar.gz": "w:gz", "tgz": "w:gz", "tar.bz2": "w:bz2", "tbz2": "w:bz2", "tar.xz": "w:xz", "txz": "w:xz"}[kind]
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, body in bodies:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(bytes(body)))
            archive.members.clear()  # else it keeps an object for each
    return out.getvalue()


ARCHIVE_FORMATS = ("zip", "tar", "tar.gz", "tgz", "tar.bz2", "tbz2", "tar.xz", "txz")


def repack_archives(
    members: DataFrame,
    fmt: str = "zip",
    *,
    preserve_structure: bool = True,
    volume_bytes: int = VOLUME_BYTES,
) -> DataFrame:
    """Members (archive, member, content[, size]) back into archives: archive, volume, volumes, members, content.

    An archive larger than `volume_bytes` is spread over several volumes, each a complete
    archive of its own with whole members: a volume holds the members that begin in its
    stretch of `volume_bytes`, in name order, so its size is bounded by that and one member.
    Only the narrow sizes are added up, and only those large archives take part in the lookup.
    Members are sorted by Spark and reach the packing worker in batches, so it holds the volume it writes and one batch.
    The members are read twice, for their sizes and for their bytes: pass a written table,
    not a long chain of work, and a `size` column, so that the first read skips the bytes.
    """
    if fmt not in ARCHIVE_FORMATS:
        raise ValueError(f"Unsupported archive format for creation: {fmt}")
    rows = members.filter(F.col("content").isNotNull()).select("archive", "member", F.col("content").cast("binary").alias("content"))
    size = F.col("size") if "size" in members.columns else F.octet_length("content")
    sizes = materialized(members.groupBy("archive", "member").agg(F.sum(F.coalesce(size, F.lit(0))).cast("bigint").alias("bytes")), "sizes")
    large = sizes.groupBy("archive").agg(F.sum("bytes").alias("all")).filter(F.col("all") > volume_bytes).select("archive")
    in_order = Window.partitionBy("archive").orderBy("member")
    before = F.coalesce(F.sum("bytes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = sizes.join(large, "archive", "left_semi").withColumn("stretch", F.floor(before / volume_bytes))
    numbers = stretch.withColumn("volume", F.dense_rank().over(Window.partitionBy("archive").orderBy("stretch")))
    places = numbers.select("archive", "member", "volume", F.max("volume").over(Window.partitionBy("archive")).alias("volumes"))
    placed = join_lookup(rows, places, ["archive", "member"], "left").withColumns(
        {"volume": F.coalesce("volume", F.lit(1)), "volumes": F.coalesce("volumes", F.lit(1))}
    )
    if not preserve_structure:
        placed = placed.withColumn("member", file_name(F.col("member")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, of = [0], []

        def counted() -> Iterator[pd.DataFrame]:
            for batch in batches:
                of[:] = of or [batch["archive"].iloc[0], int(batch["volume"].iloc[0]), int(batch["volumes"].iloc[0])]
                seen[0] += len(batch)
                yield batch

        content = _pack(fmt, counted())
        yield pd.DataFrame([(*of, seen[0], content)], columns=["archive", "volume", "volumes", "members", "content"])

    in_order = placed.repartition("archive", "volume").sortWithinPartitions("archive", "volume", F.asc_nulls_last("member"))
    return in_order.groupBy("archive", "volume").applyInPandas(
        pack, "archive string, volume int, volumes int, members int, content binary"
    )


def name_clashes(members: DataFrame) -> DataFrame:
    """Member names that collide when folders are flattened: archive, name, members."""
    return (
        members.filter(F.col("member").isNotNull())
        .groupBy("archive", file_name(F.col("member")).alias("name"))
        .agg(F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
    )


def sanitize_members(members: DataFrame, *, select: Callable[[Column], Column] = is_config_file, **options) -> DataFrame:
    """Sanitize the configuration files among members; other members keep their bytes.

    `select` tells from the member name what is a configuration file. Adds is_config, the
    result columns and `output`, the bytes to write.
    """
    chosen = F.coalesce(select(F.col("member")) & F.col("content").isNotNull(), F.lit(False))
    readable = members.withColumn("is_config", chosen)
    texts = readable.withColumn(
        "text", F.when(F.col("is_config"), decode_text(F.col("content"), normalize_newlines=False))
    )
    done = sanitize(texts, content="text", when=F.col("is_config"), **options)
    return done.withColumn(
        "output", F.when(F.col("is_config"), F.encode("sanitized", "UTF-8")).otherwise(F.col("content"))
    )


def archive_info(members: DataFrame) -> DataFrame:
    """Per archive: files, configuration files, sizes in MB, any encrypted member.

    Member lists have no bound and are not collected; they are the members table itself.
    """
    real = F.col("member").isNotNull()
    megabytes = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 1048576.0, 2)
    return members.groupBy("archive").agg(
        F.count_if(real).alias("total_files"),
        F.count_if(real & is_config_file(F.col("member"))).alias("config_files"),
        megabytes("size").alias("size_mb"),
        megabytes("compressed_size").alias("compressed_size_mb"),
        F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("encrypted"),
    )


def archive_members(members: DataFrame, *, only_config: bool = False) -> DataFrame:
    """The member list of each archive in order: archive, position, members (how many), member, is_config.

    With `only_config` the list of its configuration files. An archive of any number of
    members is numbered by many tasks.
    """
    named = members.filter(F.col("member").isNotNull()).select("archive", "member", is_config_file(F.col("member")).alias("is_config"))
    listed = numbered(named.filter("is_config") if only_config else named, ["archive"], [F.asc("member")])
    return listed.select("archive", F.col("idx").alias("position"), F.col("total").alias("members"), "member", "is_config")


def archive_result(sanitized: DataFrame) -> DataFrame:
    """Per archive: extracted and sanitized files and errors; the errors themselves are `archive_errors`."""
    return sanitized.groupBy("archive").agg(
        F.count_if(F.col("member").isNotNull() & F.col("error").isNull()).alias("extracted_files"),
        F.count_if("modified").alias("sanitized_files"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def archive_errors(members: DataFrame) -> DataFrame:
    failed = members.filter(F.col("error").isNotNull())
    name = F.coalesce(file_name(F.col("member")), file_name(F.col("archive")))
    return failed.select("archive", F.concat(name, F.lit(": "), F.col("error")).alias("error"))


def member_preview(members: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` member names of each archive, by name.

    Spark limits each archive to `n` rows per task before the shuffle (window group limit).
    """
    names = members.filter(F.col("member").isNotNull()).select("archive", "member")
    rank = F.row_number().over(Window.partitionBy("archive").orderBy("member"))
    return names.withColumn("position", rank).filter(F.col("position") <= n)
