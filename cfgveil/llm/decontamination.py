"""Find benchmark items in documents: SimHash windows, multi-index Hamming search, verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces, utf8
from cfgveil.llm.tables import join_checked, stored
from cfgveil.llm.words import Powers, U, hash_words, mix, shingles, spans

BITS = 128  # of a fingerprint
# Texts of weighted similarity 0.8 differ in 19 of 128 bits on average, with a deviation of 4.
RADIUS = 40
PARTS = 8  # blocks of 16 bits; within RADIUS some block differs in RADIUS // PARTS bits at most
# Items are searched for in groups of at most this many bytes, one pass over the documents each.
ITEM_BYTES = 64 << 20
FEW = 8  # fingerprints that are compared one by one, without tables
DENSE = 2048  # fingerprints up to which an index has bit tables, 64 KB for each; beyond, sorted block values


def plain(data: np.ndarray) -> np.ndarray:
    """Text bytes with ASCII punctuation as spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
    return table[data]


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BITS-bit fingerprints (n x 2, uint64) of windows: hashes[first[i]:first[i + 1]] are window i's shingles, repeats counting as often as they occur."""
    out = np.zeros((len(first) - 1, 2), U)
    for half in range(2):
        word = mix(hashes + U(half * 0x9E3779B97F4A7C15))
        bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
        total = np.add.reduceat(bits, first[:-1], axis=0) if len(first) > 1 else np.zeros((0, 64), np.int32)
        out[:, half] = np.packbits(total > 0, axis=1, bitorder="little").view(U).ravel()
    return out


def _near_values(radius: int) -> np.ndarray:
    """All 16-bit patterns with at most `radius` bits set."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


class HammingIndex:
    """Multi-index of fingerprints: finds all within the radius of a query, by the pigeonhole rule.

    Two fingerprints within RADIUS differ in RADIUS // PARTS bits at most in one block at least.
    Up to `dense` fingerprints each of PARTS blocks has a table from 16-bit values to the items
    whose block lies so near (64 KB for each; fewer than FEW have none). More of them are
    sorted by block value, 4 bytes for each and block, and a query looks up all values near
    its own. Both find the same pairs.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, dense: int = DENSE) -> None:
        self.prints, self.radius = prints, radius
        self.blocks = prints.view(np.uint16).reshape(-1, PARTS)
        self.near = _near_values(radius // PARTS)
        self.tables, self.sorted = [], []
        if len(prints) > dense:
            for part in range(PARTS):
                order = np.argsort(self.blocks[:, part], kind="stable").astype(np.int32)
                bounds = np.searchsorted(self.blocks[order, part], np.arange((1 << 16) + 1)).astype(np.int32)
                self.sorted.append((order, bounds))
            return
        for part in range(PARTS if len(prints) >= FEW else 0):
            mask = np.zeros((1 << 16, (len(prints) + 7) // 8), np.uint8)
            for item in range(len(prints)):
                mask[self.near ^ self.blocks[item, part], item >> 3] |= np.uint8(1 << (item & 7))
            self.tables.append(mask)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius."""
        if self.sorted:
            found = [self._near(values) for values in queries.view(np.uint16).reshape(-1, PARTS)]
            q = np.repeat(np.arange(len(queries)), [len(f) for f in found])
            i = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        elif not self.tables:
            return np.nonzero(np.bitwise_count(queries[:, None] ^ self.prints[None]).sum(axis=2) <= self.radius)
        else:
            values = queries.view(np.uint16).reshape(-1, PARTS)
            met = self.tables[0][values[:, 0]]
            for part in range(1, PARTS):
                met = met | self.tables[part][values[:, part]]
            q, i = np.nonzero(np.unpackbits(met, axis=1, bitorder="little")[:, : len(self.prints)])
        away = np.bitwise_count(queries[q] ^ self.prints[i]).sum(axis=1)
        ok = away <= self.radius
        return q[ok], i[ok]

    def _near(self, values: np.ndarray) -> np.ndarray:
        """The items that have some block near that of the query."""
        met = np.zeros(len(self.prints), bool)
        for (order, bounds), value in zip(self.sorted, values, strict=True):
            wanted = self.near ^ value
            first, last = bounds[wanted], bounds[wanted + 1]
            some = last > first
            first, n = first[some], (last - first)[some]
            met[order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]] = True
        return np.flatnonzero(met)


class Items:
    """Benchmark items by window length, with their shingles, and one Hamming index per length."""

    def __init__(self, rows: list[tuple[int, str]], size: int, powers: Powers) -> None:
        data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
        data = plain(data)
        starts, ends, first = spans(data, offsets)
        hashed, owner, _ = shingles(hash_words(data, starts, ends, powers), first, size)
        n_words = np.diff(first)
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        groups = defaultdict(list)
        for k, (item, _) in enumerate(rows):
            if n_words[k]:
                groups[int(n_words[k])].append((item, *np.unique(hashed[bounds[k] : bounds[k + 1]], return_counts=True)))
        self.by_length = {}
        for n, items in groups.items():
            flat = np.concatenate([np.repeat(v, c) for _, v, c in items])
            ends_ = np.cumsum([c.sum() for _, _, c in items])
            self.by_length[n] = (items, HammingIndex(simhash(flat, np.r_[0, ends_])))
        # The lengths of the items that hold a shingle, shingle by shingle.
        held = [(v, np.full(len(v), n)) for n, (items, _) in self.by_length.items() for _, v, _ in items]
        value, length = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, U), np.zeros(0, np.int64))
        order = np.lexsort((length, value))
        value, length = value[order], length[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (length[1:] != length[:-1])
        self.known, self.first = np.unique(value[new], return_index=True)
        self.first, self.length = np.append(self.first, new.sum()), length[new]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> U(44)).astype(np.int64)] = True

    def hits(self, hashed: np.ndarray) -> np.ndarray:
        """Where `hashed` has shingles of items."""
        at = np.flatnonzero(self.filter[(hashed >> U(44)).astype(np.int64)])
        return at[np.isin(hashed[at], self.known)]

    def lengths(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `hashed`, length) for every length of an item that holds the shingle; all are known ones."""
        k = np.searchsorted(self.known, hashed)
        n = self.first[k + 1] - self.first[k]
        return np.repeat(np.arange(len(hashed)), n), self.length[np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets (sorted values, counts)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    return both / (int(na.sum()) + int(nb.sum()) - both)


def _matches(hashed: np.ndarray, hits: np.ndarray, n_words: int, items: Items, size: int, percent: int) -> Iterator[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window of one document for each item found.

    `hashed`: the document's shingles in order; `hits`: where they are shingles of items. Two
    windows of w shingles have similarity s only if they share 2 w s / (1 + s); so windows
    with fewer hits of items of their length cannot match and are not fingerprinted.
    """
    of, lengths = items.lengths(hashed[hits])
    for length in np.unique(lengths).tolist():
        at_hits = hits[of[lengths == length]]
        rows, index = items.by_length[length]
        if length > n_words or (length < size and length != n_words):
            continue
        width = max(1, length - size + 1)  # shingles of a window
        hit = np.zeros(len(hashed) + 1, np.int64)
        hit[at_hits + 1] = 1
        seen = np.cumsum(hit)
        starts = np.flatnonzero((100 + percent) * (seen[width:] - seen[: len(seen) - width]) >= 2 * width * percent)
        best: dict[int, tuple[float, int]] = {}
        for part in np.array_split(starts, max(1, len(starts) * width >> 16)):
            if not len(part):
                continue
            windows = hashed[(part[:, None] + np.arange(width)).ravel()]
            found, item = index.search(simhash(windows, np.arange(len(part) + 1) * width))
            for q, k in zip(found.tolist(), item.tolist(), strict=True):
                at = int(part[q])
                alike = similarity(*np.unique(hashed[at : at + width], return_counts=True), rows[k][1], rows[k][2])
                if 100 * alike >= percent - 1e-9 and (k not in best or alike > best[k][0]):
                    best[k] = (alike, at)
        for k, (alike, at) in best.items():
            yield rows[k][0], at, length, alike


def contaminated(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", *, item: str = "item_id", item_text: str = "text",
    shingle: int = 5, percent: int = 80, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Benchmark items that occur in documents, exactly or nearly.

    Returns (id, item, first_word, n_words, similarity), one row for each row of `df` and
    item found in it: the best window (the first of equal ones). A document's windows have as
    many words as the item; one matches if the weighted Jaccard similarity of the two
    multisets of `shingle`-word shingles is `percent` / 100 or more. Windows are
    fingerprinted by SimHash, a multi-index returns every item within RADIUS bits, and the
    exact similarity decides. Words are runs without spaces, x09-x0D and ASCII punctuation, A-Z
    lower-cased. An
    item with fewer than `shingle` words matches only documents that consist of it.

    Null and empty texts match nothing, on either side; null ids are carried as they are;
    items of equal text are all reported; repeated rows each give their rows. Other columns
    are not read. No shuffle: items go to the tasks in groups of at most `item_bytes` of
    text (any number of items), one pass over the documents for each group.
    """
    spark = df.sparkSession
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    groups = max(1, -(-2 * (total or 0) // item_bytes))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    out = None
    for group in range(groups):
        batch = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows.where(F.col("group") == group).toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            items = Items(batch.value, shingle, powers)
            for table in pieces(batches, 1 << 20):
                data, offsets = utf8(table["text"])
                data = plain(data)
                starts, ends, first = spans(data, offsets)
                hashed, owner, _ = shingles(hash_words(data, starts, ends, powers), first, shingle)
                bounds = np.searchsorted(owner, np.arange(len(offsets)))
                hits = items.hits(hashed)
                cuts = np.searchsorted(hits, bounds)
                doc = table["id"].to_pylist()
                found = [
                    (doc[k], *m)
                    for k in np.flatnonzero(np.diff(cuts)).tolist()
                    for m in _matches(hashed[bounds[k] : bounds[k + 1]], hits[cuts[k] : cuts[k + 1]] - bounds[k], int(first[k + 1] - first[k]), items, shingle, percent)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        names = ["id", "item", "first_word", "n_words", "similarity"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        part = docs.mapInArrow(run, "id long, item long, first_word long, n_words long, similarity double")
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id), F.col("item").alias(item), "first_word", "n_words", "similarity")


def without_benchmark(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, whose id has no benchmark item in it (see `contaminated`)."""
    found = contaminated(df, benchmark, id, text, **options)
    bad, _ = stored(found.select(F.col(id).alias("__bad")).distinct(), "contaminated")
    return join_checked(df, bad, {id: "__bad"}, "left_anti", 16)
