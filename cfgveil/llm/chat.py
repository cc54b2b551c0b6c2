"""Conversations as training text with a loss mask, assembled column by column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces, utf8
from cfgveil.llm.tables import drop, join_checked, stored

# The template. Each control string begins with < or [ and one of / s I R <.
OPEN = b"<s>"
PARTS = {  # role -> (before the text, after it)
    b"system": (b"<<SYS>>\n", b"\n<</SYS>>\n"),
    b"user": (b"[INST] ", b" [/INST]"),
    b"assistant": (b" ", b" </s>"),
}
OTHER = (b"[ROLE ", b"] ", b" [/ROLE]")  # any other role, its name as hexadecimal UTF-8
OPEN_ENDED = np.frombuffer(b"<[\\", np.uint8)
STEP = 1 << 20  # bytes that are escaped or gathered at once: index arrays take many times as much


def escape_points(data: np.ndarray) -> np.ndarray:
    """Where a backslash is put in: after each < or [ that is followed by any number of
    backslashes and one of / s I R <. What follows a text's last byte must not be one of these.
    """
    out, a = [], 0
    while a < len(data):
        b = min(a + STEP, len(data))
        while b < len(data):  # on to a byte that no control string goes on after
            solid = np.flatnonzero(~np.isin(data[b - 1 : b - 1 + STEP], OPEN_ENDED))
            if len(solid):
                b += int(solid[0])
                break
            b = min(b + STEP, len(data))
        out.append(_escape_points(data[a:b]) + a)
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _escape_points(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "/sIR<"]] = True
    at = np.flatnonzero((data == ord("<")) | (data == ord("[")))
    if not len(at):
        return at
    solid = np.flatnonzero(data != ord("\\"))
    following = np.searchsorted(solid, at, side="right")
    at, following = at[following < len(solid)], following[following < len(solid)]
    return at[table[data[solid[following]]]] + 1


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with their control strings broken by backslashes, as (bytes, offsets)."""
    if not len(data):
        return data, offsets
    # A newline between texts keeps a control string from reaching over their border.
    apart = np.insert(data, offsets[1:-1], ord("\n"))
    points = escape_points(apart)
    text = np.searchsorted(offsets[1:-1] + np.arange(len(offsets) - 2), points, side="left")
    points = points - text
    return np.insert(data, points, ord("\\")), offsets + np.searchsorted(points, offsets, side="left")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\(?=\\*[/sIR<])", r"\1", text)


def assemble(turns: pa.Table) -> pa.Table:
    """(conv, formatted, loss) of turns that are grouped by conversation and in order; with a
    column `part` (conv, part, formatted, loss) of parts of conversations.

    Every turn is three segments (head, text, tail) and every conversation begins with one
    more (a part other than 0 does not). Lengths give offsets by cumulative sums, offsets give the source of every byte of
    the result, and gathers of STEP bytes fill the buffer that becomes the Arrow column. `loss` has the
    (first byte, end) pairs of the assistant texts in the formatted UTF-8 bytes.
    """
    n = len(turns)
    conv = turns["conv"].combine_chunks()
    key = conv.fill_null(0).to_numpy() if n else np.zeros(0, np.int64)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
    part = turns["part"].to_numpy() if "part" in turns.column_names else np.zeros(n, np.int64)
    new[1:] |= part[1:] != part[:-1]
    content, at = escaped(*utf8(turns["text"]))
    roles, role_at = utf8(turns["role"])
    names = [roles[a:b].tobytes() for a, b in zip(role_at[:-1].tolist(), role_at[1:].tolist(), strict=True)]
    pool, where, heads, tails = bytearray(OPEN), {}, [], []
    for name in names:
        if name not in where:
            head, tail = PARTS.get(name) or (OTHER[0] + name.hex().encode() + OTHER[1], OTHER[2])
            where[name] = ((len(pool), len(head)), (len(pool) + len(head), len(tail)))
            pool += head + tail
        heads.append(where[name][0])
        tails.append(where[name][1])
    source = np.concatenate([np.frombuffer(bytes(pool), np.uint8), content])
    # Segments: opening (of length 0 inside a conversation), head, text, tail.
    start, length = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    length[:, 0] = (new & (part == 0)) * len(OPEN)
    start[:, 1], length[:, 1] = np.array(heads, np.int64).reshape(-1, 2).T
    start[:, 2], length[:, 2] = len(pool) + at[:-1], np.diff(at)
    start[:, 3], length[:, 3] = np.array(tails, np.int64).reshape(-1, 2).T
    to = np.concatenate([[0], np.cumsum(length.ravel())])
    out = np.empty(to[-1], np.uint8)
    fill(out, source, start.ravel(), to)
    first = np.flatnonzero(new)
    offsets = np.append(to[:-1].reshape(n, 4)[first, 0], to[-1]).astype(np.int64) if n else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    own = np.array([x == b"assistant" for x in names], bool)
    conversation = np.cumsum(new) - 1
    begin = to[:-1].reshape(n, 4)[:, 2][own] - offsets[conversation[own]]
    spans = np.stack([begin, begin + length[:, 2][own]], axis=1).ravel()
    counts = 2 * np.bincount(conversation[own], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(spans, pa.int64()))
    parts = {c: turns[c].combine_chunks().take(pa.array(first)) for c in ("part", "parts") if c in turns.column_names}
    return pa.table({"conv": conv.take(pa.array(first)), **parts, "formatted": formatted.cast(pa.string()), "loss": loss})


def fill(out: np.ndarray, source: np.ndarray, start: np.ndarray, to: np.ndarray) -> None:
    """Segment k of `out`, to[k]:to[k + 1], from source[start[k]:]; long segments are cut."""
    for a in range(0, len(out), STEP):
        b = min(a + STEP, len(out))
        i, j = np.searchsorted(to, a, side="right") - 1, np.searchsorted(to, b, side="left")
        length = np.minimum(to[i + 1 : j + 1], b) - np.maximum(to[i:j], a)
        np.take(source, np.repeat(start[i:j] - to[i:j], length) + np.arange(a, b), out=out[a:b])


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, batch_bytes: int = 2 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """(conv, part, parts, formatted, loss): each conversation, turns in order, no turn left out.

    A conversation is one row, part 0 of 1, if its texts and roles have `part_bytes` bytes at
    most. A longer one is several rows, whole turns in order: a part holds the turns that begin
    in its stretch of `part_bytes` bytes. The texts of the parts one after another are the
    conversation, and `loss` counts from the beginning of its own part. Rows come in no order.

    Turns are ordered by turn (nulls first), then role, then text. Null texts and roles count
    as empty; a role other than system, user and assistant keeps its name; control strings
    inside texts are escaped, so `parse` gives back every turn. Rows with a null conversation
    id are one conversation. Repeated rows are turns of their own. Other columns are not read.
    An empty table gives an empty table.

    Rows are hash-partitioned by conversation and part, so a conversation of any length is
    spread over the cluster; a task holds one part and never a whole long conversation.
    """
    rows = df.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    keys = ["conv", "part", "turn", "role", "text"]
    ordered = _in_parts(rows, part_bytes).repartition("conv", "part").sortWithinPartitions(*keys).select("conv", "part", "parts", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        of = None  # the conversation and part of the row before
        for table in pieces(batches, batch_bytes):
            pairs = list(zip(table["conv"].to_pylist(), table["part"].to_pylist(), strict=True))
            last = next((k for k in range(len(pairs) - 1, 0, -1) if pairs[k] != pairs[k - 1]), 0)
            if held and (last or pairs[0] != of):
                whole = [*held, table.slice(0, last)] if pairs[0] == of else held
                yield from assemble(pa.concat_tables(whole)).to_batches()
                if pairs[0] != of and last:
                    yield from assemble(table.slice(0, last)).to_batches()
                held = []
            elif last:
                yield from assemble(table.slice(0, last)).to_batches()
            held.append(table.slice(last))
            of = pairs[-1]
        if held:
            yield from assemble(pa.concat_tables(held)).to_batches()

    return ordered.mapInArrow(run, "conv long, part long, parts long, formatted string, loss array<long>").withColumnRenamed("conv", conv)


def _in_parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """`rows` with the number of each turn's part and of its conversation's parts.

    Conversations of more than `part_bytes` are range-partitioned in order and written; the
    bytes before a turn are those of earlier ranges, one small row for each range and
    conversation, and those before it in its own.
    """
    size = (F.octet_length("role") + F.octet_length("text")).cast("long")
    large, path = stored(rows.groupBy(F.col("conv").alias("of")).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > part_bytes), "large")
    if large.isEmpty():
        drop(rows.sparkSession, path)
        return rows.withColumns({"part": F.lit(0).cast("long"), "parts": F.lit(1).cast("long")})
    small = join_checked(rows, large, {"conv": "of"}, "left_anti", 32).withColumns({"part": F.lit(0).cast("long"), "parts": F.lit(1).cast("long")})
    order = ["turn", "role", "text"]
    ranged = join_checked(rows, large, {"conv": "of"}, "left_semi", 32).repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id())
    laid, _ = stored(ranged.withColumn("size", size), "turns")
    sums = laid.groupBy("conv", "range").agg(F.sum("size").alias("bytes"))
    earlier = F.sum("bytes").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets, _ = stored(sums.select(F.col("conv").alias("c"), F.col("range").alias("r"), F.coalesce(earlier, F.lit(0)).alias("earlier")), "offsets")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("conv", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = join_checked(laid.withColumn("inside", inside), offsets, {"conv": "c", "range": "r"}, "inner", 32)
    placed, _ = stored(met.select("conv", *order, F.floor((F.col("earlier") + F.col("inside")) / part_bytes).cast("long").alias("stretch")), "placed")
    whole = Window.partitionBy("c")
    found = placed.select(F.col("conv").alias("c"), F.col("stretch").alias("s")).distinct()  # a row for each part
    numbers, _ = stored(found.select("c", "s", (F.row_number().over(whole.orderBy("s")) - 1).cast("long").alias("part"), F.count(F.lit(1)).over(whole).alias("parts")), "parts")
    return small.unionByName(join_checked(placed, numbers, {"conv": "c", "stretch": "s"}, "inner", 40).select("conv", *order, "part", "parts"))


TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE (?P<name>[0-9a-f]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def parse(formatted: str, part: int = 0) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation or part of one; raises if it isn't one."""
    turns, at = [], 0 if part else len(OPEN)
    if not part and not formatted.startswith(OPEN.decode()):
        raise ValueError("no opening")
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m.lastgroup != "other" else bytes.fromhex(m["name"]).decode()
        turns.append((role, unescape(m[m.lastgroup])))
        at = m.end()
    return turns
