"""Remove byte strings that occur before, through Burrows-Wheeler transforms of candidate regions.

Every string of `length` bytes is assigned to an anchor, the smallest hashed 24-byte string
in it (the leftmost of equal ones). Equal strings have equal anchors, so a string repeats only
if its anchor does. Blocks of documents ask shards which anchors repeat, and send the regions
around those, each distinct one once. A shard lays its regions out as one text, sorts it,
and derives common prefixes from its Burrows-Wheeler transform breadth-first, by increasing
length, until `length`: suffixes not separated by then begin with equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cfgveil.llm.blocks import BLOCK_BYTES, answer, ask, ids, n_shards, pack, pack_arrays, settle, settle_packets, unpack, unpack_arrays, utf8, write_blocks
from cfgveil.llm.tables import stored
from cfgveil.llm.words import Powers, U, byte_values, mix

GRAM = 24
CHUNK = 1 << 17
# Bytes laid out for one transform; an anchor with more regions than that has one of its own.
TEXT_BYTES = 3 << 19
# An anchor with more distinct regions than this is split by the strings themselves.
HOT_REGIONS = 1 << 18
END, LAST = 0xFF, 0xFE  # never in UTF-8


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes ordered by their first `length` bytes at least (ties as they come)."""
    n = len(text)
    index = np.arange(n, dtype=U)
    bits = U(max(1, int(n).bit_length()))
    padded = np.concatenate([text, np.zeros(4, np.uint8)]).astype(U)
    key = (padded[:n] << U(24)) | (padded[1 : n + 1] << U(16)) | (padded[2 : n + 2] << U(8)) | padded[3 : n + 3]
    packed = np.sort((key << bits) | index)
    width = 4
    while True:
        order = (packed & ((U(1) << bits) - U(1))).astype(np.int64)
        head = packed >> bits
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.concatenate([[True], head[1:] != head[:-1]])).astype(U)
        if width >= length:
            return order
        after = np.zeros(n, U)
        after[: max(0, n - width)] = rank[width:]
        if 3 * int(bits) <= 64:
            packed = np.sort((rank << (U(2) * bits)) | (after << bits) | index)
        else:  # too long to pack: order by both ranks, then number the pairs again
            order = np.lexsort((after, rank)).astype(np.int64)
            pair = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])])
            packed = (np.cumsum(pair).astype(U) << bits) | order.astype(U)
        width *= 2


def separated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each position of the sorted suffixes, whether less than `length` bytes are common with the one before.

    Threshold-bounded interval expansion. A boundary of common prefix 0 stands where the first
    byte changes. Extending backwards by a byte takes the suffixes that this byte precedes in
    the transform to their places; two neighbours among them have a common prefix of m + 1 if
    the least one between their sources is m. So the boundaries of prefix m, and they alone,
    give those of m + 1, and the search ends at `length`, or when a level adds none.
    """
    n = len(text)
    first = text[order]
    cut = np.ones(n, bool)
    cut[1:] = first[1:] != first[:-1]
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    source = place[(order + 1) % n]  # where each suffix stands without its first byte
    low, high = np.zeros(n, np.int32), np.zeros(n, np.int32)
    np.minimum(source[1:], source[:-1], out=low[1:])
    np.maximum(source[1:], source[:-1], out=high[1:])
    close = high == low + 1
    far = np.flatnonzero(~cut & ~close)
    far_low, far_high = low[far], high[far]
    new = np.flatnonzero(cut)
    for _ in range(1, length):
        if not len(new):
            break
        # Neighbours whose sources are neighbours, too: only the boundary between these counts.
        at = place[order[new] - 1]  # (the suffix 0 has the last one before it; it is never close)
        found = []
        for shift in (0, 1):
            j = at + shift
            ok = j < n
            j, b = j[ok], new[ok]
            found.append(j[close[j] & ~cut[j] & (high[j] == b)])
        if len(far):
            count = np.cumsum(cut, dtype=np.int32)
            hit = count[far_high] > count[far_low]
            found.append(far[hit])
            far, far_low, far_high = far[~hit], far_low[~hit], far_high[~hit]
        new = np.unique(np.concatenate(found))
        cut[new] = True
    return cut


def regions_of(data: np.ndarray, ends: np.ndarray, length: int, powers: Powers) -> dict[str, np.ndarray]:
    """The regions of concatenated documents: maximal runs of string starts with one anchor.

    start and span: of the run; anchor: hash of its 24 bytes; id: hash of the bytes from the
    run's first to the end of its last string. `ends`: where documents end.
    """
    gram = min(GRAM, length)
    width, values = length - gram + 1, byte_values(fold=False)
    out: list[tuple] = []
    at = 0
    while at + length <= len(data):
        stop = min(at + CHUNK, len(data) - length + 1)  # starts of this chunk
        piece = data[at : stop + length - 1]
        up, down = powers.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(values[piece] * up[: len(piece)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: len(piece) - gram + 1])
        low = (U(1) << U(int(len(grams)).bit_length())) - U(1)
        best = (grams & ~low) | np.arange(len(grams), dtype=U)
        span = 1
        while 2 * span <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if width > span:
            best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
        starts = np.arange(at, stop)
        owner = ends[np.searchsorted(ends, starts, side="right")]
        valid = owner - starts >= length
        anchor = (best & low).astype(np.int64)
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(first)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        runs = np.flatnonzero(last) + 1 - begin
        body = mix((total[begin + runs + length - 1] - total[begin]) * down[begin] + runs.astype(U))
        out.append((begin + at, runs, grams[anchor[begin]], body))
        at = stop
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)]
    return dict(zip(("start", "span", "anchor", "id"), parts, strict=True))


def single_strings(data: np.ndarray, regions: dict[str, np.ndarray], length: int, powers: Powers) -> dict[str, np.ndarray]:
    """Regions cut into their strings, each its own anchor."""
    starts = np.repeat(regions["start"] - np.concatenate([[0], np.cumsum(regions["span"])[:-1]]), regions["span"]) + np.arange(regions["span"].sum())
    h = np.zeros(len(starts), U)
    values, base = byte_values(fold=False), U(0x9E3779B97F4A7C15)
    for k in range(length):
        h = h * base + values[data[starts + k]]
    h = mix(h)
    return {"start": starts, "span": np.ones(len(starts), np.int64), "anchor": h, "id": mix(h + U(1))}


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mix(anchor + U(7)) % U(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


def _laid_out(table: pa.Table, id: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row order by id, ids in it, bytes, document ends)."""
    doc = ids(table[id])
    order = np.argsort(doc, kind="stable")
    data, offsets = utf8(table[text].take(pa.array(order)))
    return order, doc[order], data, offsets[1:]


def remove_repeats(
    df: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = 100, block_bytes: int = BLOCK_BYTES, hot_regions: int = HOT_REGIONS, text_bytes: int = TEXT_BYTES
) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier.

    Returns (id, n_bytes, n_removed, n_spans, kept), one row for each row of `df`; kept is
    binary, as a removal may cut a character. Earlier: in a smaller id, or in the same
    document further left; strings may overlap and are judged on the input. They never reach
    over a document's end; a text shorter than `length` keeps everything.

    A null text is empty; a null id is smaller than any other; of rows that share an id the
    earlier is the one stored first, so of repeated rows one stays whole. Other columns of
    `df` are not read. An empty table gives an empty table.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(f"`{id}`"), F.col(f"`{text}`"))
    schema = T.StructType([df.schema[id], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    blocks, _ = write_blocks(narrow, block_bytes)
    if blocks.isEmpty():
        return spark.createDataFrame([], schema)
    anchor_shards, region_shards = n_shards(blocks, 32 << 20), n_shards(blocks, 4 << 20)

    def question(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, _, data, ends = _laid_out(table, id, text)
        r = regions_of(data, ends, length, Powers())
        order = np.lexsort((r["id"], r["anchor"]))
        anchor, body = r["anchor"][order], r["id"][order]
        if not len(anchor):
            return
        head = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        distinct = head | np.concatenate([[True], body[1:] != body[:-1]])
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(anchor)))
        kinds = np.add.reduceat(distinct.astype(np.int64), at)
        anchor = anchor[at]
        for shard, part in _by_shard(_shard(anchor, anchor_shards)):
            yield shard, pack_arrays(anchor=anchor[part], twice=n[part] > 1, kinds=kinds[part].astype(np.uint32))

    def which_repeat(_shard: int, where: list[int], packets: list[bytes]) -> Iterator[tuple[int, bytes]]:
        asked = [unpack_arrays(p) for p in packets]
        every, back = np.unique(np.concatenate([a["anchor"] for a in asked]), return_inverse=True)
        n = np.bincount(back, weights=1.0 + np.concatenate([a["twice"] for a in asked]))
        kinds = np.bincount(back, weights=np.concatenate([a["kinds"] for a in asked]))
        at = 0
        for block, a in zip(where, asked, strict=True):
            mine = back[at : at + len(a["anchor"])]
            at += len(mine)
            repeats = n[mine] > 1
            if repeats.any():
                yield block, pack_arrays(anchor=a["anchor"][repeats], hot=kinds[mine][repeats] > hot_regions)

    def candidates(data: np.ndarray, ends: np.ndarray, replies: list[dict]) -> dict[str, np.ndarray]:
        """The block's regions with repeated anchors, by place; hot ones as single strings."""
        powers = Powers()
        r = regions_of(data, ends, length, powers)
        if not replies:
            return {k: v[:0] for k, v in r.items()}
        known = np.concatenate([x["anchor"] for x in replies])
        hot = np.concatenate([x["hot"] for x in replies])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        at = np.minimum(np.searchsorted(known, r["anchor"]), len(known) - 1)
        chosen = known[at] == r["anchor"]
        plain = {k: v[chosen & ~hot[at]] for k, v in r.items()}
        if not hot.any():
            return plain
        split = single_strings(data, {k: v[chosen & hot[at]] for k, v in r.items()}, length, powers)
        both = {k: np.concatenate([plain[k], split[k]]) for k in plain}
        order = np.argsort(both["start"], kind="stable")
        return {k: v[order] for k, v in both.items()}

    def send_regions(table: pa.Table, replies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        _, docs, data, ends = _laid_out(table, id, text)
        r = candidates(data, ends, [unpack_arrays(x) for x in replies])
        _, first, n = np.unique(r["id"], return_index=True, return_counts=True)
        start, span = r["start"][first], r["span"][first]
        doc = docs[np.searchsorted(ends, start, side="right")]
        for shard, part in _by_shard(_shard(r["anchor"][first], region_shards)):
            sizes = span[part] + length - 1
            at = np.concatenate([[0], np.cumsum(sizes)])
            body = data[np.repeat(start[part] - at[:-1], sizes) + np.arange(at[-1])]
            texts = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
            columns = {"anchor": r["anchor"][first][part], "id": r["id"][first][part], "doc": doc[part], "start": start[part], "many": n[part] > 1}
            yield shard, pack(pa.table({**{k: pa.array(v) for k, v in columns.items()}, "text": texts}))

    def judge(_shard: int, where: list[int], packets: list[bytes]) -> Iterator[tuple[int, bytes]]:
        tables = [unpack(p) for p in packets]
        whole = pa.concat_tables(tables)
        sizes = [len(t) for t in tables]
        block = np.repeat(np.array(where), sizes)
        c = {k: whole[k].to_numpy() for k in ("anchor", "id", "doc", "start", "many")}
        order = np.lexsort((c["start"], block, c["doc"], c["id"], c["anchor"]))
        owner = order[np.concatenate([[True], c["id"][order][1:] != c["id"][order][:-1]])]  # first of each region, by anchor
        body, offsets = utf8(whole["text"])
        del tables, whole
        mask = _earlier(c, block, owner, body, offsets, length, text_bytes)
        owned = np.zeros(len(block), bool)
        owned[owner] = True
        bits = np.zeros((len(block), mask.shape[1]), np.uint8)
        bits[owner] = mask
        at = 0
        for b, n in zip(where, sizes, strict=True):
            mine = slice(at, at + n)
            at += n
            told = ~owned[mine] | c["many"][mine] | bits[mine].any(axis=1)
            if told.any():
                kept_bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), int(told.sum()), [None, pa.py_buffer(np.ascontiguousarray(bits[mine][told]))])
                yield b, pack(pa.table({"id": pa.array(c["id"][mine][told]), "owned": pa.array(owned[mine][told]), "bits": kept_bits}))

    def use(table: pa.Table, replies: list[bytes]) -> pa.Table:
        order, _, data, ends = _laid_out(table, id, text)
        opened = [unpack(x) for x in replies]
        asked = [{k: t[k].to_numpy() for k in ("anchor", "hot")} for t in opened if "hot" in t.column_names]
        verdicts = [t for t in opened if "bits" in t.column_names]
        cover = np.zeros(len(data) + 1, np.int32)
        if verdicts:
            r = candidates(data, ends, asked)
            told = pa.concat_tables(verdicts).combine_chunks()
            known, owned = told["id"].to_numpy(), told["owned"].to_numpy()
            raw = told["bits"].chunk(0)
            wide = raw.type.byte_width
            bits = np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * wide : (raw.offset + len(raw)) * wide].reshape(-1, wide)
            sort = np.argsort(known)
            at = sort[np.minimum(np.searchsorted(known, r["id"], sorter=sort), len(known) - 1)]
            met = known[at] == r["id"]
            lead = np.zeros(len(met), bool)
            lead[np.unique(r["id"], return_index=True)[1]] = True
            part = met & lead & owned[at]
            all_ = met & ~part
            np.add.at(cover, r["start"][all_], 1)
            np.add.at(cover, r["start"][all_] + r["span"][all_] + length - 1, -1)
            row, window = np.nonzero(np.unpackbits(bits[at[part]], axis=1))
            strings = r["start"][part][row] + window
            np.add.at(cover, strings, 1)
            np.add.at(cover, strings + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        removed = np.concatenate([[0], np.cumsum(gone)])
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        inside = begins[begins < len(data)]
        fresh[inside] = gone[inside]
        runs = np.concatenate([[0], np.cumsum(fresh)])
        left = data[~gone]
        offsets = np.append(begins - removed[begins], len(left)).astype(np.int64)
        if offsets[-1] < 1 << 31:
            kept = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(left)])
        else:
            kept = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(left)])
        return pa.table({
            id: table[id].take(pa.array(order)), "n_bytes": pa.array(ends - begins), "n_removed": pa.array(removed[ends] - removed[begins]),
            "n_spans": pa.array(runs[ends] - runs[begins]), "kept": kept,
        })

    repeated, _ = stored(answer(ask(blocks, question), which_repeat), "anchors")
    verdicts = answer(settle_packets(blocks, repeated, send_regions), judge)
    return settle(blocks, repeated.union(verdicts), use, schema)


def _earlier(c: dict[str, np.ndarray], block: np.ndarray, owner: np.ndarray, body: np.ndarray, offsets: np.ndarray, length: int, text_bytes: int) -> np.ndarray:
    """For each region of `owner`, the bits of its strings that start earlier in another place."""
    sizes = np.diff(offsets)[owner]
    span = sizes - length + 1
    mask = np.zeros((len(owner), length - min(GRAM, length) + 1), bool)  # a run has no more strings
    rank = np.empty(len(block), np.int64)  # of (doc, block)
    order = np.lexsort((block, c["doc"]))
    step = (c["doc"][order][1:] != c["doc"][order][:-1]) | (block[order][1:] != block[order][:-1])
    rank[order] = np.concatenate([[0], np.cumsum(step)])
    anchors = c["anchor"][owner]
    heads = np.append(np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])), len(owner))
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(before[heads], before[heads[i]] + text_bytes, side="right")) - 1)
        lo, hi = heads[i], heads[j]
        i = j
        mine = owner[lo:hi]
        at = np.concatenate([[0], np.cumsum(sizes[lo:hi] + 1)])
        text = np.full(at[-1] + 1, END, np.uint8)
        text[-1] = LAST
        inner = np.repeat(at[:-1], sizes[lo:hi]) + _ramp(sizes[lo:hi])
        text[inner] = body[np.repeat(offsets[:-1][mine], sizes[lo:hi]) + _ramp(sizes[lo:hi])]
        suffixes = sort_suffixes(text, length)
        groups = np.cumsum(separated(text, suffixes, length))
        # Strings in suffix order, with their group and their place in the corpus.
        row = np.full(len(text), -1, np.int64)
        windows = np.repeat(at[:-1], span[lo:hi]) + _ramp(span[lo:hi])
        row[windows] = np.repeat(np.arange(hi - lo), span[lo:hi])
        held = row[suffixes] >= 0
        where, group = suffixes[held], groups[held]
        r = row[where]
        place = (rank[mine[r]].astype(U) << U(40)) | (c["start"][mine[r]] + where - at[r]).astype(U)
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(place, head)
        later = place > np.repeat(least, np.diff(np.append(head, len(place))))
        mask[lo + r[later], (where - at[r])[later]] = True
    return np.packbits(mask, axis=1)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of `sizes`."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(total[-1]) - np.repeat(total[:-1], sizes)
