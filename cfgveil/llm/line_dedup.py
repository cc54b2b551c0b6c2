"""Drop lines that many documents share, through sharded minimal perfect hashing.

A line's key is the line with spaces and x09-x0D stripped at both ends and A-Z lower-cased.
Each block of documents sends every hash shard the distinct line hashes it holds. A shard
builds a minimal perfect hash over its distinct hashes; the slots index a fingerprint array
and a saturating array of document counts, and the repeated slots an array of keepers. The
packets then probe these arrays, and each block learns which of its lines to drop. Lines are
never joined with lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cfgveil.llm.blocks import BLOCK_BYTES, answer, ask, ids, n_shards, pack_arrays, settle, unpack_arrays, utf8, write_blocks
from cfgveil.llm.words import U, mix

WHITE = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: a cascade of bit arrays.

    On each level a key claims one of about two slots per key left; keys alone in their slot
    stay there, the others go on to the next level. A key's index is the rank of its bit.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        before = 0
        while len(high):
            size = 2 * len(high) + 1
            slot = self._slot(high, low, len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + before
            before = int(rank[-1]) + 1
            self.levels.append(alone)
            self.ranks.append(rank)
            left = ~alone[slot]
            high, low = high[left], low[left]
        self.size = before

    @staticmethod
    def _slot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(high + low * U(2 * level + 1) + U(level)) % U(size)).astype(np.int64)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each key; any index, or -1, for a key that is not in the set."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = self._slot(high[left], low[left], level, len(alone))
            found = alone[slot]
            out[left[found]] = rank[slot[found]]
            left = left[~found]
        return out


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key has fewer than `min_chars` code points."""
    key = line.strip(WHITE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _texts(table: pa.Table, text: str) -> list[bytes]:
    data, offsets = utf8(table[text])
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def dedup_lines(
    df: DataFrame, id: str = "doc_id", text: str = "text", *, min_docs: int = 3, min_chars: int = 20,
    stats: bool = False, shard_bytes: int = 32 << 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Drop lines whose key at least `min_docs` documents hold, save in the largest id holding it.

    Returns `df` with `text` replaced by the lines that stay, joined by newlines; other
    columns, whatever their names, stay as they are. With `stats` it returns (id, n_lines,
    n_dropped, kept_text) instead, one row for each row of `df`.

    Lines end at \\n only. A null or empty text is one empty line and gives the empty text.
    Keys of fewer than `min_chars` code points are never dropped. Rows that share an id are
    one document: it counts once, and keeps all its lines where it is the largest. A null id
    is an id of its own, smaller than any other. An empty table gives an empty table.
    """
    spark = df.sparkSession
    blocks, _ = write_blocks(df, block_bytes)
    shards = n_shards(blocks, shard_bytes)

    def question(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        holders: dict[bytes, set[int]] = {}
        for doc, body in zip(ids(table[id]).tolist(), _texts(table, text), strict=True):
            for line in body.split(b"\n"):
                if (key := line_key(line, min_chars)) is not None:
                    held = holders.setdefault(key, set())
                    held.add(doc)
                    if len(held) > min_docs:  # the largest, and others up to min_docs: enough to tell
                        held.remove(min(held))
        if not holders:
            return
        keys = np.frombuffer(b"".join(holders), np.uint64).reshape(-1, 2)
        sizes = np.array([len(x) for x in holders.values()])
        docs = np.array([d for x in holders.values() for d in sorted(x)], np.int64)
        keys = np.repeat(keys, sizes, axis=0)
        to = (mix(keys[:, 0]) % U(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        keys, docs, to = keys[order], docs[order], to[order]
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            yield int(to[part[0]]), pack_arrays(high=keys[part, 0], low=keys[part, 1], doc=docs[part])

    def reply(_shard: int, blocks_: list[int], packets: list[bytes]) -> Iterator[tuple[int, bytes]]:
        asked = [unpack_arrays(p) for p in packets]
        high, low, doc = (np.concatenate([a[k] for a in asked]) for k in ("high", "low", "doc"))
        order = np.lexsort((doc, low, high))
        high, low, doc = high[order], low[order], doc[order]
        new_key = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
        at = np.flatnonzero(new_key)
        documents = np.add.reduceat(new_doc.astype(np.int64), at)
        largest = doc[np.r_[at[1:], len(doc)] - 1]
        key_high, key_low = high[at], low[at]

        table = PerfectHash(key_high, key_low)
        slot = table.index(key_high, key_low)
        prints = np.empty(table.size, np.uint32)
        counts = np.empty(table.size, np.uint32)
        prints[slot] = (key_low >> U(32)).astype(np.uint32)
        counts[slot] = np.minimum(documents, min_docs)
        repeated = counts >= min_docs
        keeper_at = np.cumsum(repeated) - 1
        keepers = np.empty(int(repeated.sum()), np.int64)
        chosen = documents >= min_docs
        keepers[keeper_at[slot[chosen]]] = largest[chosen]

        for block, a in zip(blocks_, asked, strict=True):
            probe = table.index(a["high"], a["low"])
            hit = (probe >= 0) & (prints[probe] == (a["low"] >> U(32)).astype(np.uint32)) & repeated[probe]
            if hit.any():
                yield block, pack_arrays(high=a["high"][hit], low=a["low"][hit], keeper=keepers[keeper_at[probe[hit]]])

    def use(table: pa.Table, replies: list[bytes]) -> pa.Table:
        lost: dict[bytes, int] = {}
        for r in map(unpack_arrays, replies):
            keys = np.stack([r["high"], r["low"]], axis=1).tobytes()
            lost.update((keys[16 * i : 16 * i + 16], k) for i, k in enumerate(r["keeper"].tolist()))
        kept, total, dropped = [], [], []
        for doc, body in zip(ids(table[id]).tolist(), _texts(table, text), strict=True):
            lines = body.split(b"\n")
            stay = lines
            if lost:
                stay = [x for x in lines if (key := line_key(x, min_chars)) is None or lost.get(key, doc) == doc]
            kept.append(b"\n".join(stay))
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        if stats:
            return pa.table({id: table[id], "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_text": texts})
        return table.set_column(table.column_names.index(text), text, texts)

    schema = T.StructType([df.schema[id], *(T.StructField(n, k) for n, k in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType())))]) if stats else df.schema
    replies = answer(ask(blocks, question), reply)
    return spark.createDataFrame([], schema) if blocks.isEmpty() else settle(blocks, replies, use, schema).select(*[F.col(f"`{c}`") for c in schema.names])
