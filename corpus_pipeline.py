"""From raw documents to packed training batches, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. Only doc_id, text, source and n_chars are read; other
columns come back as they are, whatever their names. Texts that are null, empty or of few words
go in the first stage; rows with a null id are judged by their own text and stay if it is good;
repeated rows and rows that share an id stay or go together, except that only their own
lines are dropped. An empty table gives no batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.llm.decontamination import without_benchmark
from cfgveil.llm.host_rules import keep_good
from cfgveil.llm.line_dedup import dedup_lines
from cfgveil.llm.near_dup import without_near_duplicates
from cfgveil.llm.packing import pack, token_counts
from cfgveil.llm.queries import VOCABULARY
from cfgveil.session import materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share go, save in the largest doc_id holding them."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return without_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in length buckets of least padding: the training order."""
    return pack(token_counts(docs, VOCABULARY), max_tokens=2048, buckets=8, batch_tokens=16384)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the SimHash and SuperMinHash stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
