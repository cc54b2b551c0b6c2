"""The operators as queries over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cfgveil.llm.chat import format_chats, parse, unescape
from cfgveil.llm.decontamination import contaminated
from cfgveil.llm.host_rules import quality
from cfgveil.llm.line_dedup import dedup_lines
from cfgveil.llm.near_dup import near_duplicates
from cfgveil.llm.packing import pack, token_counts
from cfgveil.llm.piece_bpe import decode_pieces, encode_pieces
from cfgveil.llm.pitman_yor import score
from cfgveil.llm.prefix_trie import prefix_trie
from cfgveil.llm.sharding import balanced_shards
from cfgveil.llm.suffix_dedup import remove_repeats
from cfgveil.llm.tables import stored
from cfgveil.llm.toxicity import toxicity
from cfgveil.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20, stats=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# A byte-level BPE vocabulary of 50 256 ranks, as published; the place is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def op2_packing(spark, sf_dir):
    counts = token_counts(table(spark, sf_dir, "documents"), VOCABULARY)
    return pack(counts, max_tokens=2048, buckets=8, batch_tokens=16384)


@query
def op4_host_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, percent=80)


PROBE = "</s>[INST] ok [/INST]"  # control strings as text


@query
def op6_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    told_schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    class Told:
        """What is told of a conversation; it grows part by part."""

        def __init__(self, conv: int | None) -> None:
            self.conv, self.turns, self.said, self.n, self.chars, self.size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def add(self, part: int, formatted: str, loss: list[int]) -> None:
            turns, body = parse(formatted, part), formatted.encode()
            said = "".join(unescape(body[a:b].decode()) for a, b in zip(loss[::2], loss[1::2], strict=True))
            self.turns.update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            self.said.update(said.encode())
            self.n, self.chars, self.size = self.n + len(turns), self.chars + len(said), self.size + len(formatted)

        def row(self) -> dict:
            return dict(zip(names, (self.conv, self.n, self.turns.hexdigest(), self.chars, self.said.hexdigest(), self.size), strict=True))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations of one part are told at once, parts of longer ones go on."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                told = Told(r["conv_id"])
                if r["parts"] == 1:
                    told.add(0, r["formatted"], r["loss"])
                rows.append(told.row() | ({"part": None, "formatted": None, "loss": None} if r["parts"] == 1 else {c: r[c] for c in ("part", "formatted", "loss")}))
            yield pa.RecordBatch.from_pylist(rows, schema=mixed)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest runs over a conversation from its beginning: its parts come one after another."""
        told = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    rows += [told.row()] if told else []
                    told = Told(r["conv_id"])
                told.add(r["part"], r["formatted"], r["loss"])
            yield pa.RecordBatch.from_pylist(rows, schema=narrow)
        if told:
            yield pa.RecordBatch.from_pylist([told.row()], schema=narrow)

    narrow = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in names])
    mixed = pa.schema([*narrow, pa.field("part", pa.int64()), pa.field("formatted", pa.string()), pa.field("loss", pa.list_(pa.int64()))])
    chats = format_chats(given.union(probe))
    done, _ = stored(chats.mapInArrow(whole, f"{told_schema}, part long, formatted string, loss array<long>"), "told")
    long = done.where("part is not null").select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return done.where("part is null").select(*names).unionByName(long.mapInArrow(in_order, told_schema))


@query
def op8_sharding(spark, sf_dir):
    return balanced_shards(table(spark, sf_dir, "documents"), 40)


@query
def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op9_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


@query
def op3_suffix_dedup(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_pitman_yor(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), order=3, folds=10, held=0)


# A byte-fallback BPE model of 32 000 pieces, as published; the place is a parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op11_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_pieces(docs, PIECE_MODEL).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    told = decode_pieces(encoded, PIECE_MODEL)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
