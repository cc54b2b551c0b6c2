"""Documents as numbered blocks, and messages between blocks and hash shards.

Operators that compare every document with the whole corpus lay the documents out once as
blocks of a few megabytes (one row each, a compressed Arrow table). A block sends each hash
shard one packet with its distinct keys; the shard answers packet by packet, and the
answers meet their block again. A key of any frequency costs a shard at most one entry per
block, so a line, passage or word that a third of the corpus holds lands on no task whole.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.tables import parallelism, stored

BLOCK_BYTES = 8 << 20
NO_ID = -(1 << 63)  # stands for a null id: smaller than any other


def pack(table: pa.Table) -> bytes:
    """A table as compressed Arrow bytes."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue()


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Equally long arrays as one packet."""
    return pack(pa.table({k: pa.array(v) for k, v in arrays.items()}))


def unpack_arrays(body: bytes) -> dict[str, np.ndarray]:
    table = unpack(body)
    return {k: table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in table.column_names}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Integer ids; null is NO_ID."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy()


def pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes (or one row) out of record batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(batch.num_rows, limit // each // 4))
        while at < batch.num_rows:
            part = batch.slice(at, step)
            at += part.num_rows
            bytes_ = part.nbytes
            if held and size + bytes_ > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += bytes_
    if held:
        yield pa.Table.from_batches(held)


def write_blocks(
    df: DataFrame, block_bytes: int = BLOCK_BYTES, extra: str = "", summary: Callable[[pa.Table], dict] | None = None
) -> tuple[DataFrame, str]:
    """`df` as stored blocks (block long, n_bytes long, body binary, and what `summary` adds; it may give the body)."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        for k, table in enumerate(pieces(batches, block_bytes)):
            row = {"block": (part << 32) | k, "n_bytes": table.nbytes} | (summary(table) if summary else {})
            if "body" not in row:
                row["body"] = pack(table)
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    spec = "block long, n_bytes long, body binary" + (f", {extra}" if extra else "")
    schema = _arrow(df.sparkSession, spec)
    return stored(df.mapInArrow(cut, spec), "blocks", blobs=True)


def _arrow(spark, spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(", "))])


def n_shards(blocks: DataFrame, shard_bytes: int) -> int:
    """Hash shards for the corpus: one for `shard_bytes` of it, and one per core at least."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(parallelism(blocks.sparkSession), -(-total // shard_bytes))


PACKET = "shard long, block long, body binary"
PACKET_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])


def ask(blocks: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]], columns: list[str] | None = None) -> DataFrame:
    """Packets (shard, block, body): what `question` makes of each block's documents."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                for shard, packet in question(unpack(body.as_py())):
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "body": packet}], schema=PACKET_SCHEMA)

    return blocks.select("block", "body").mapInArrow(run, PACKET)


def answer(packets: DataFrame, reply: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Replies (shard, block, body): `reply` sees all packets of one shard, by block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        shard = table["shard"][0].as_py()
        rows = [{"shard": shard, "block": b, "body": x} for b, x in reply(shard, table["block"].to_pylist(), table["body"].to_pylist())]
        return pa.Table.from_pylist(rows, schema=PACKET_SCHEMA)

    return packets.groupBy("shard").applyInArrow(run, PACKET)


def settle(blocks: DataFrame, replies: DataFrame, use: Callable[[pa.Table, list[bytes]], pa.Table], schema) -> DataFrame:
    """`use` on each block's documents and the replies to it (none, if no shard had any)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        out = [use(unpack(body), right["body"].to_pylist()) for body in left["body"].to_pylist()]
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    empty = to_arrow_schema(kind).empty_table()
    return blocks.select("block", "body").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, kind)


def settle_packets(blocks: DataFrame, replies: DataFrame, use: Callable[[pa.Table, list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """As `settle`, for a further question to the shards: `use` gives (shard, packet)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        rows = [
            {"shard": shard, "block": block, "body": packet}
            for block, body in zip(left["block"].to_pylist(), left["body"].to_pylist(), strict=True)
            for shard, packet in use(unpack(body), right["body"].to_pylist())
        ]
        return pa.Table.from_pylist(rows, schema=PACKET_SCHEMA)

    return blocks.select("block", "body").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, PACKET)
