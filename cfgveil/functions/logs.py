"""Log redaction, for batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a log line sensitive.
SENSITIVE_WORDS = ("password", "secret", "key", "token", "credential")


def redact_log(message: Column) -> Column:
    """`k=v` words become `k=<redacted>` in messages that hold a sensitive word and an `=`."""
    sensitive = F.lower(message).rlike("|".join(SENSITIVE_WORDS)) & F.contains(message, F.lit("="))
    redacted = F.regexp_replace(message, r"(^| )([^ =]*)=[^ ]*", "$1$2=<redacted>")
    return F.when(sensitive, redacted).otherwise(message)
