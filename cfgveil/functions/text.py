"""Text, path and hash columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_text(content: Column, *, normalize_newlines: bool = True) -> Column:
    """Bytes as UTF-8 text with invalid bytes dropped; CRLF and CR become LF if asked.

    A genuine U+FFFD in the input is dropped as well.
    """
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n") if normalize_newlines else text


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """The last suffix with its dot; empty for names like `.profile` or `name`."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path)))


def sanitized_name(path: Column, *, extension: Column | str | None = None, stamp: Column | None = None) -> Column:
    """Output path: one `_sanitized` stripped from the stem, then `_sanitized[_stamp]` and the extension."""
    folder = parent_dir(path)
    stem = F.regexp_replace(file_stem(path), r"_sanitized\z", "")
    ending = file_suffix(path) if extension is None else (F.lit(extension) if isinstance(extension, str) else extension)
    name = F.concat(stem, F.lit("_sanitized"), ending)
    if stamp is not None:
        name = F.concat(stem, F.lit("_sanitized_"), stamp, ending)
    return F.when(F.contains(path, F.lit("/")), F.concat(folder, F.lit("/"), name)).otherwise(name)


def content_hash(content: Column, digits: int = 32) -> Column:
    return F.substring(F.md5(content), 1, digits)


def token_hash(secret_type: Column, index: Column) -> Column:
    """A stable 12-digit upper-case pseudonym of a secret type and an index."""
    return F.upper(F.substring(F.md5(F.concat_ws("_", secret_type, index.cast("string"))), 1, 12))
