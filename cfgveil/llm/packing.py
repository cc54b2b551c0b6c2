"""Pack documents into batches of equal length with little padding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces
from cfgveil.llm.tables import drop, stored
from cfgveil.operators.ranking import numbered

# How the vocabulary splits text before merging (fixed value of the published vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The tokenizer's matcher runs out of stack on white space of some hundred thousand characters
# (those that have the property in Unicode), so long runs are matched here.
SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def token_counts(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text, by a byte-level BPE vocabulary file in rank format.

    The file is read once by the driver and sent to the tasks. Null counts as empty. Texts are
    encoded whole, with white space of any length (see `count_tokens`).
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for part in pieces(batches, 1 << 20):
            counts = [count_tokens(coder, t or "") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    narrow = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "id long, n_tokens long").withColumnRenamed("id", id)


def count_tokens(coder, text: str) -> int:
    """The number of tokens that `coder.encode_ordinary` gives, for any text.

    PATTERN takes a run of white space up to its last character as one word, as no word reaches
    into it from before, and the last one goes with what follows; a run at the text's end is
    one word as a whole. So a long run is encoded as that word, without matching it.
    """
    n = at = 0
    for run in SPACE_RUN.finditer(text):
        to = run.end() if run.end() == len(text) else run.end() - 1
        n += len(coder.encode_ordinary(text[at : run.start()])) + len(coder._encode_single_piece(text[run.start() : to]))
        at = to
    return n + len(coder.encode_ordinary(text[at:]))


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least total padding.

    `lengths`: distinct, ascending. Every item is padded to its bucket's bound. Dynamic
    programming over the histogram: best[j] is the least padding of the lengths up to j.
    """
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    m = len(lengths)
    if m == 0:
        return []
    best = lengths * n[1:] - total[1:]
    cuts = []
    for _ in range(min(buckets, m) - 1):
        before = np.concatenate([[0.0], best])  # before[i]: lengths below index i are done
        new, cut = np.empty(m), np.zeros(m, np.int64)
        for j in range(m):
            cost = before[: j + 1] + lengths[j] * (n[j + 1] - n[: j + 1]) - (total[j + 1] - total[: j + 1])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    bounds, j = [int(lengths[-1])], m - 1
    for cut in reversed(cuts):
        j = int(cut[j]) - 1
        if j < 0:
            break
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def pack(lengths: DataFrame, id: str = "doc_id", length: str = "n_tokens", *, max_tokens: int = 2048, buckets: int = 8, batch_tokens: int = 16384) -> DataFrame:
    """Batches of a token budget, formed inside length buckets that minimise padding.

    Returns (id, piece, first_token, n_tokens, bucket, padded, batch, slot): one row for each
    piece of each row of `lengths`. Every document has an end token; one longer than
    `max_tokens` is cut into consecutive pieces, so all of its tokens are packed and the
    histogram has `max_tokens` rows at most, which is what the driver reads. The bounds come
    from the global histogram by dynamic programming; all pieces in a bucket are padded to
    its bound, and `batch_tokens` // bound of them (one at least) make a batch, numbered
    from 0 inside the bucket, in id order (nulls first), then piece, then length; rows equal
    in these are taken as they come.

    A null length counts as 0 tokens and so makes a piece of the end token alone; other
    columns are not read; an empty table gives an empty table.
    """
    spark = lengths.sparkSession
    size = F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long") + 1
    whole = lengths.select(F.col(f"`{id}`").alias("id"), size.alias("size"))
    step = F.lit(max_tokens)
    cut = whole.select("id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {max_tokens}"))).alias("piece"))
    cut = cut.select("id", "piece", (F.col("piece") * step).alias("first_token"), F.least(step.cast("long"), F.col("size") - F.col("piece") * step).alias("n_tokens"))
    parts, path = stored(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = np.array(sorted(map(tuple, parts.groupBy("n_tokens").count().collect())), np.int64).reshape(-1, 2)  # max_tokens rows at most
    bounds = bucket_bounds(histogram[:, 0], histogram[:, 1], buckets)
    bucket, padded = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for k, bound in enumerate(bounds[1:], 1):
        above = F.col("n_tokens") > bounds[k - 1]
        bucket, padded = F.when(above, F.lit(k)).otherwise(bucket), F.when(above, F.lit(bound).cast("long")).otherwise(padded)
    placed = parts.withColumns({"bucket": bucket, "padded": padded})
    order = [F.col(c) for c in ("id", "piece", "n_tokens", "place")]
    ranked = numbered(placed, ["bucket"], order)
    drop(spark, path)
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("padded")).cast("long"))
    nth = F.col("idx") - 1
    return ranked.select(
        F.col("id").alias(id), "piece", "first_token", "n_tokens", "bucket", "padded",
        F.floor(nth / rows).cast("long").alias("batch"), (nth % rows).cast("long").alias("slot"),
    )
