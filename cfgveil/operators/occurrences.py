"""Which of many literal strings a text holds, and how often.

Up to AUTOMATON_CHARS characters of literals are one Aho-Corasick automaton: a text is read
once, in its place, whatever their number. Of longer lists the workers hold a bitmap of hashes:
each text is read in its place, the places whose bytes the bitmap may know are cut out, and
only these few strings meet the literals, by equality. Either way no join carries a text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cfgveil.session import join_lookup, materialized

# The functions below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters in one automaton; a worker holds some 50 bytes for each.
AUTOMATON_CHARS = 2 << 20
# Bits of the bitmap for each literal, the bits at most (64 MB), and how many of them a literal sets.
BITS_EACH, MOST_BITS, TESTS = 32, 1 << 29, 4
CHUNK_BITS = 1 << 16
# A hash reads so many bytes of a literal at most, from both its ends.
HASHED = 32
PLACES_AT_ONCE = 1 << 20
COUNTS = "array<struct<literal:int,n:bigint>>"


def count_literals(text: str, automaton, lengths: Sequence[int]) -> list[tuple[int, int]]:
    """(number, count) of the literals in a text, by number; occurrences of one don't overlap, from the left."""
    ends: dict[int, int] = {}
    counts: dict[int, int] = {}
    for end, k in automaton.iter(text):
        if ends.get(k, -1) <= end - lengths[k]:
            ends[k] = end
            counts[k] = counts.get(k, 0) + 1
    return sorted(counts.items())


def counted_literals(text: Column, literals: Sequence[str]) -> Column:
    """array of (literal, n): the literals a text holds by their number in the list, in its order.

    `literals` are distinct and not empty. A null text holds none.
    """
    words = list(literals)

    @F.pandas_udf(COUNTS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, lengths = ahocorasick.Automaton(), [len(w) for w in words]
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        automaton.make_automaton()
        for batch in texts:
            found = [count_literals(t, automaton, lengths) if t and words else [] for t in batch]
            yield pd.Series([[{"literal": k, "n": n} for k, n in counts] for counts in found], dtype=object)

    return find(text)


def literal_counts(df: DataFrame, literals: DataFrame, *, content: str = "content", key: str = "path", automaton_chars: int | None = None) -> DataFrame:
    """(key, literal, n): the literals (`literal`, repeated or empty ones ignored) each text holds, and how often.

    Occurrences of one literal don't overlap, counted from the left; those of different
    literals may. Rows of one key are one text's parts: their counts are added.
    """
    limit = AUTOMATON_CHARS if automaton_chars is None else automaton_chars
    words = literals.select("literal").where("length(literal) > 0").distinct()
    chars = words.agg(F.sum(F.length("literal"))).first()[0] or 0
    return _by_automaton(df, words, content, key) if chars <= limit else _by_windows(df, words, content, key)


def _by_automaton(df: DataFrame, words: DataFrame, content: str, key: str) -> DataFrame:
    """One pass over the texts; the literals pass the driver at once."""
    listed = sorted(r[0] for r in words.collect())
    rows = df.select(F.col(key), F.inline(counted_literals(F.col(content), listed)))
    # The list is a constant of the plan, not a column of its rows.
    return rows.groupBy(key, "literal").agg(F.sum("n").alias("n")).withColumn("literal", F.get(_array(listed), F.col("literal")))


def _array(values: Sequence[str]) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def slots(data: np.ndarray, at: np.ndarray, size: int, bits: int) -> Iterator[np.ndarray]:
    """The bits that stand for the `size` bytes at each place, one array for each test."""
    offsets = range(size) if size <= HASHED else [*range(HASHED // 2), *range(size - HASHED // 2, size)]
    h = np.full(len(at), size, np.uint64)
    for k in offsets:
        h = (h ^ data[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(TESTS):
        yield (h + np.uint64(k) * step) & np.uint64(bits - 1)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, where each begins and the end); a null string is empty."""
    plain = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = plain.buffers()
    ends = np.frombuffer(offsets, np.int64, len(plain) + 1, 8 * plain.offset)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """Every literal's bits set: made by the executors in chunks, `bits / 8` bytes on the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8_bytes(batch.column(0))
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                for slot in slots(data, ends[:-1][sizes == size], size, bits):
                    yield pa.RecordBatch.from_arrays([pa.array((slot // CHUNK_BITS).astype(np.int64)), pa.array((slot % CHUNK_BITS).astype(np.int32))], ["chunk", "bit"])

    def packed(table: pa.Table) -> pa.Table:
        chunk = np.zeros(CHUNK_BITS, np.uint8)
        chunk[table["bit"].to_numpy()] = 1
        return pa.table({"chunk": table["chunk"][:1], "body": pa.array([np.packbits(chunk, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, np.uint8)
    for row in words.mapInArrow(places, "chunk bigint, bit int").groupBy("chunk").applyInArrow(packed, "chunk bigint, body binary").toLocalIterator():
        at = row["chunk"] * (CHUNK_BITS // 8)
        whole[at : at + CHUNK_BITS // 8] = np.frombuffer(row["body"], np.uint8)
    return whole


def _by_windows(df: DataFrame, words: DataFrame, content: str, key: str) -> DataFrame:
    """Any number of literals of any kind, in one pass over the texts for each length they have.

    Occurrences are sought in bytes, which for UTF-8 finds the same. A place is kept where its
    first two bytes begin some literal and all bits of its window are set; what the bitmap
    takes for a literal by chance finds none in the join. The rows that travel are what the texts hold.
    """
    fixed = materialized(words, "literals")
    spark, raw = df.sparkSession, F.encode("literal", "UTF-8")
    sizes = sorted(r[0] for r in fixed.select(F.octet_length("literal")).distinct().collect())
    bits = CHUNK_BITS
    while bits < min(fixed.count() * BITS_EACH, MOST_BITS):
        bits *= 2
    begins = np.zeros((256, 256), bool)  # by second and first byte
    for r in fixed.select(F.substring(raw, 1, 2).alias("head")).distinct().collect():
        begins[r["head"][1] if len(r["head"]) > 1 else slice(None), r["head"][0]] = True
    sent = spark.sparkContext.broadcast((begins.reshape(-1), _bitmap(fixed, bits)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known = sent.value
        for batch in batches:
            data, ends = utf8_bytes(batch.column(1))
            counts: dict[tuple[int, bytes], list[int]] = {}  # (row, literal): [end of the last one, how many]
            last = int(ends[-1])
            for a in range(int(ends[0]), last, PLACES_AT_ONCE):
                b = min(a + PLACES_AT_ONCE, last)
                head = data[a:b].astype(np.uint16)
                follow = data[a + 1 : b + 1] if b < len(data) else np.append(data[a + 1 : b], np.uint8(0))
                at = np.flatnonzero(first[head | follow.astype(np.uint16) << np.uint16(8)]) + a
                row = np.searchsorted(ends, at, "right") - 1
                room = ends[row + 1] - at
                for size in sizes:
                    fits = room >= size
                    place, of = at[fits], row[fits]
                    every = np.arange(len(place))
                    for slot in slots(data, place, size, bits):
                        slot = slot[every]
                        every = every[(known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    for p, r in zip(place[every].tolist(), of[every].tolist(), strict=True):
                        told = counts.setdefault((r, data[p : p + size].tobytes()), [-1, 0])
                        if p >= told[0]:
                            told[0], told[1] = p + size, told[1] + 1
            rows, names, numbers = [], [], []
            for (r, name), (_, n) in counts.items():
                try:
                    names.append(name.decode())
                except UnicodeDecodeError:  # cut within a character: no literal
                    continue
                rows.append(r)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(numbers, pa.int64())], [key, "literal", "n"])

    shape = StructType([StructField(key, df.schema[key].dataType), StructField("literal", StringType()), StructField("n", LongType())])
    found = df.select(F.col(key), F.col(content)).mapInArrow(find, shape)
    return join_lookup(found, fixed, "literal").groupBy(key, "literal").agg(F.sum("n").alias("n"))
