"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

For each shingle SuperMinHash draws a random permutation of the signature's slots, step by
step; the value of a step is its rank plus a random fraction. Ranks of one shingle are
correlated (each occurs once), which lowers the variance of the estimate, and a text is done
as soon as every slot holds a value below the next rank: long texts after one or two steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces, utf8
from cfgveil.llm.components import components
from cfgveil.llm.tables import drop, join_checked, stored
from cfgveil.llm.words import Powers, U, hash_words, mix, shingles, spans

# With 32 bands of 4 slots a pair of similarity 0.8 shares no band with a chance of 5e-8.
SLOTS, BANDS = 128, 32
# A bucket that is not connected yet has this many centers, then as many times more on each turn.
CENTERS = 64
# So many members of a bucket at most that have not met each other are tested in full.
FEW = 8
# Words of 64 bits of a set's parity bitmap.
PARITY = 8


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n x slots, uint32) of `n` sets; element i belongs to set `owner[i]`.

    Values are rank * 2^24 + 24 random bits; a set without elements keeps the largest value.
    """
    signature = np.full(n * slots, np.iinfo(np.uint32).max, np.uint32)
    drawn: list[np.ndarray] = []
    for step in range(slots):
        x = mix(elements + U(((step + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        other = step + (((x & U(0xFFFFFFFF)) * U(slots - step)) >> U(32)).astype(np.int64)
        slot = other
        for back in range(step - 1, -1, -1):  # where the earlier swaps took the slot from
            slot = np.where(slot == drawn[back], back, slot)
        np.minimum.at(signature, owner * slots + slot, (U(step << 24) | (x >> U(40))).astype(np.uint32))
        drawn.append(other)
        open_ = signature.reshape(n, slots).max(axis=1) >= (step + 1) << 24
        going = open_[owner]
        if not going.any():
            break
        if not going.all():
            elements, owner = elements[going], owner[going]
            drawn = [d[going] for d in drawn]
    return signature.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band (n x bands)."""
    n, slots = signature.shape
    rows = signature.reshape(n, bands, slots // bands).astype(U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (n, bands)).copy()
    for r in range(slots // bands):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def text_sets(column: pa.ChunkedArray, size: int, powers: Powers) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted; and all of them with their texts."""
    data, offsets = utf8(column)
    starts, ends, first = spans(data, offsets)
    hashed, owner, _ = shingles(hash_words(data, starts, ends, powers), first, size)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    sets = [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return sets, hashed, owner


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps (len(sets) x PARITY words): bit g tells whether an odd number of a set's elements hash to g.

    Two bitmaps differ in at most as many bits as the sets differ in elements.
    """
    words = np.zeros((len(sets), PARITY), U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    g = mix(np.concatenate([np.zeros(0, U), *sets])) % U(64 * PARITY)
    np.bitwise_xor.at(words, (owner, (g >> U(6)).astype(np.int64)), U(1) << (g & U(63)))
    return words


def _digests(bodies: list[bytes]) -> np.ndarray:
    """128-bit hashes as pairs of integers."""
    return np.frombuffer(b"".join(hashlib.blake2b(b, digest_size=16).digest() for b in bodies), np.int64).reshape(-1, 2)


def _signed(df: DataFrame, size: int) -> DataFrame:
    """(id, n, set_a, set_b, keys, bits): set size, 128-bit hash of the set, band keys, parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in pieces(batches, 1 << 20):
            sets, hashed, owner = text_sets(table["text"], size, powers)
            digests = _digests([s.tobytes() for s in sets])
            keys = band_keys(superminhash(hashed, owner, len(sets))).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (keys, parities(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists],
                ["id", "n", "set_a", "set_b", "keys", "bits"],
            )

    return df.mapInArrow(run, "id long, n long, set_a long, set_b long, keys array<long>, bits array<long>")


def _sets(df: DataFrame, size: int) -> DataFrame:
    """(node, set_a, body): half of the set's hash, the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in pieces(batches, 1 << 20):
            sets, _, _ = text_sets(table["text"], size, powers)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            body = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, U), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(_digests([s.tobytes() for s in sets])[:, 0]), body], ["node", "set_a", "body"])

    return df.mapInArrow(run, "node long, set_a long, body array<long>")


def _alone(sets: DataFrame) -> DataFrame:
    """(node, set_a, alone): how many shingles of a set no other of `sets` has; none: no row."""
    each = sets.select("node", "set_a", F.explode("body").alias("h"))
    # Where the count is one, the least value is the only one.
    single = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("set_a").alias("set_a"))
    return single.where("n = 1").groupBy("node", "set_a").agg(F.count(F.lit(1)).alias("alone"))


def _rare_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, set_a, n, most): buckets of the rarest shingles of each set, any two of `sets` that are linked in one at least.

    Of n shingles two linked sets share `percent` of either's. In one order for all sets, by
    rising frequency, the first n - ceil(n * percent / 100) + 1 of each thus have one in common.
    Shingles that no other set has come first and bring nobody together, so the sets of a
    family whose members differ by more than linked ones may have few keys or none.

    `most` is what the set may share with one whose first common shingle is `key`: itself and
    those after it. So linked sets pass this bound in the bucket of their first common shingle.
    """
    each = sets.select("node", "set_a", F.size("body").alias("n"), F.explode("body").alias("key"))
    often = each.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mine = Window.partitionBy("node", "set_a")
    known = each.join(often, F.col("key") == F.col("of")).withColumns({"nth": F.row_number().over(mine.orderBy("m", "key")), "known": F.count(F.lit(1)).over(mine)})
    place = F.col("n") - F.col("known") + F.col("nth")
    return known.where(place <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "node", "set_a", "n", (F.col("n") - place + 1).alias("most"))


def _meeting(members: DataFrame, percent: int) -> DataFrame:
    """The rows of `members` that have another in their bucket, of a size that they and it may meet the similarity with."""
    # 100 * most >= percent * (n + other - most): `percent` times the largest other set.
    reach = (100 + percent) * F.col("most") - percent * F.col("n")
    bounds = members.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max(reach).alias("widest")).where("m > 1")
    met = members.join(bounds, F.col("key") == F.col("of")).where((percent * F.col("least") <= reach) & (percent * F.col("n") <= F.col("widest")))
    return met.drop("of", "m", "least", "widest")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the similarity.

    Sets are compared row by row inside the join: whole sets of thousands of pairs are never
    gathered in one Arrow batch.
    """
    left = pairs.join(sets.select("node", F.col("body").alias("left")), F.col("a") == F.col("node")).drop("node")
    whole = left.join(sets.select("node", F.col("body").alias("right")), F.col("b") == F.col("node")).drop("node")
    both = F.size(F.array_intersect("left", "right")).cast("long")
    # both / (sizes - both) >= percent / 100, with `both` named once.
    return whole.where((100 + percent) * both >= percent * (F.size("left") + F.size("right")).cast("long")).select("a", "b").distinct()


def _shared_buckets(members: DataFrame) -> DataFrame:
    """The rows of `members` whose key has other members, with their number `m`."""
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("key", "of")
    return members.join(full, F.col("key") == F.col("of")).drop("of")


def _across(members: DataFrame, centers: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of a member and a center of its bucket in different components that may meet the similarity.

    Two exact bounds leave pairs out within the join: what either set shares with any other
    bounds the intersection, and the bits in which the bitmaps differ bound it from the other side.
    """
    c = centers.select(F.col("key").alias("of"), F.col("node").alias("center"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("bits").alias("bits2"), F.col("component").alias("other"))
    both, total = F.least("s", "s2"), F.col("n") + F.col("n2")
    differing = reduce(Column.__add__, [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(PARITY)])
    fitting = (100 * both >= percent * (total - both)) & ((100 + percent) * (total - differing) >= 2 * percent * total)
    pairs = members.join(c, (F.col("key") == F.col("of")) & (F.col("component") != F.col("other")) & (F.col("node") != F.col("center")) & fitting)
    return pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _same_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of ids that have several texts with the nodes of these texts' sets."""
    several = rows.where("id IS NOT NULL").groupBy("id").agg(*[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("set_a", "set_b")])
    several = several.where("minset_a <> maxset_a OR minset_b <> maxset_b").select(F.col("id").alias("b"))
    own = rows.where("n > 0").join(several, F.col("id") == F.col("b")).select("set_a", "set_b", "b")
    return own.join(nodes.select("set_a", "set_b", F.col("node").alias("a")), ["set_a", "set_b"]).where("a <> b").select("a", "b").distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Link texts whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    Returns (id, n_shingles, component_id, kept), one row for each row of `df`: set size, the
    smallest id reachable over links, and whether the row's id is that one. Words are runs
    without spaces and x09-x0D, A-Z lower-cased; a text with fewer than `shingle` words has
    its whole sequence as one shingle; one without words (or null) has no shingle and is
    linked with nothing. Other columns of `df` are not read. Rows that share an id are one
    node, linked by what any of them is like. Rows with a null id are linked with nothing,
    have a null component and are kept. An empty table gives an empty table.

    Equal sets become one node first, with partial aggregation, so copies are never paired.
    Band buckets then propose links; those that pass exact bounds (parity bitmaps, shared
    shingles) are verified on the full sets: every member with the one member of its bucket
    that shares most buckets (a family's origin). Where this leaves the others of a bucket
    unconnected, up to FEW of them are tested with each other; the sets of buckets with more
    are dealt anew, to buckets of their rarest shingles, which hold every link among them;
    there a bucket is tested with CENTERS, CENTERS^2... of its members, across components
    only, until it is connected or has been tested in full; a pair passes where what both
    sets hold from the bucket's shingle on is enough for a link. So no link that any band
    proposes is missing from the components, a bucket of true near copies costs one pair for
    each member, and alike texts that stay unlinked meet only where they share rare shingles.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows, rows_path = stored(_signed(docs, shingle), "signatures")
    nodes, nodes_path = stored(
        rows.where("n > 0 AND id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "nodes"
    )
    bands = nodes.select("node", "set_a", "n", F.explode("keys").alias("key"))
    members, members_path = stored(_shared_buckets(bands), "members")
    candidates, candidates_path = stored(members.select("node").distinct(), "candidates")
    sets, sets_path = stored(_sets(join_checked(docs, candidates, {"id": "node"}, "left_semi", 16), shingle), "sets")
    # A set shares with another at most what is in any other set: less than `percent`, and
    # it has no link at all. Many sets of a large family leave their buckets here.
    linkable = members.join(_alone(sets), ["node", "set_a"], "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
    linkable, linkable_path = stored(_shared_buckets(linkable.where(100 * F.col("s") >= percent * F.col("n")).select("node", "set_a", "n", "s", "key")), "linkable")
    drop(spark, members_path, candidates_path)
    weight = linkable.groupBy("node", "set_a").agg(F.sum("m").alias("weight")).join(nodes.select("node", "set_a", "bits"), ["node", "set_a"])
    weighed, weighed_path = stored(linkable.join(weight, ["node", "set_a"]).select("key", "node", "set_a", "n", "s", "weight", "bits"), "weighed")
    drop(spark, linkable_path)
    links, links_path = stored(_same_id(rows, nodes), "linked")
    tested, tested_path = stored(spark.createDataFrame([], "a long, b long"), "tested")
    groups = spark.createDataFrame([], "node long, component long") if links.isEmpty() else components(links)

    def unjoined(buckets: DataFrame) -> DataFrame:
        """The members of buckets that lie in several components, with theirs."""
        found = groups.select(F.col("node").alias("of"), "component")
        state = buckets.join(found, F.col("node") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "node"))
        apart = state.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select(F.col("key").alias("of"))
        return state.join(apart, F.col("key") == F.col("of")).drop("of")

    def connect(members: DataFrame, centers: DataFrame) -> None:
        """Test the members with the centers of their buckets, and take up the links."""
        nonlocal links, links_path, tested, tested_path, groups
        pairs, pairs_path = stored(_across(members, centers, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            drop(spark, pairs_path)
            return
        fresh, fresh_path = stored(_linked(pairs, sets, percent), "fresh")
        nothing_new = fresh.isEmpty()
        new_links, new_path = stored(links.union(fresh), "linked")
        new_tested, new_tested_path = stored(tested.union(pairs), "tested")
        drop(spark, fresh_path, pairs_path, links_path, tested_path)
        links, links_path, tested, tested_path = new_links, new_path, new_tested, new_tested_path
        if not nothing_new:
            groups = components(links)

    fields = ["node", "n", "s", "bits", "component"]
    state, state_path = stored(unjoined(weighed), "unjoined")
    first = F.max_by(F.struct("set_a", *fields), F.struct("weight", (-F.col("node")).alias("least")))  # pre-aggregated: a bucket of any size
    centers, centers_path = stored(state.groupBy("key").agg(first.alias("c")).select("key", "c.*"), "centers")
    connect(state, centers)
    # A center has met its whole bucket, so only pairs of the others are open.
    open_, open_path = stored(_shared_buckets(unjoined(weighed.join(centers.select("key", "node", "set_a"), ["key", "node", "set_a"], "left_anti"))), "open")
    drop(spark, state_path, centers_path)
    few = open_.where(F.col("m") <= FEW)
    connect(few, few)
    wide = unjoined(open_.where(F.col("m") > FEW).drop("component"))
    rest, rest_path = stored(wide.select("node", "set_a", "n", "s", "weight", "bits").distinct(), "rest")
    drop(spark, open_path)
    placed, placed_path = stored(_rare_buckets(sets.join(rest.select("node", "set_a"), ["node", "set_a"], "left_semi"), percent), "placed")
    # The bound of the place holds within the bucket; a link passes it in the first one that its sets share.
    rare = _meeting(placed, percent).drop("n").join(rest, ["node", "set_a"]).withColumn("s", F.least("s", "most"))
    rare, rare_path = stored(rare.drop("most"), "rare")
    drop(spark, placed_path)
    used, used_path = stored(spark.createDataFrame([], "key long, node long, set_a long"), "used")
    largest = rare.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    tried = 1  # centers of a bucket so far
    while tried < largest:
        tried *= CENTERS
        state, state_path = stored(unjoined(rare), "unjoined")
        nearest = Window.partitionBy("key").orderBy(F.desc("weight"), "node", "set_a")
        free = state.join(used, ["key", "node", "set_a"], "left_anti").withColumn("nth", F.row_number().over(nearest))
        centers, centers_path = stored(free.where(F.col("nth") <= tried).select("key", "set_a", *fields), "centers")
        connect(state, centers)
        new_used, new_used_path = stored(used.union(centers.select("key", "node", "set_a")), "used")
        drop(spark, state_path, centers_path, used_path)
        used, used_path = new_used, new_used_path
    drop(spark, weighed_path, rest_path, rare_path, used_path)
    whole = nodes.select("set_a", "set_b", "node").join(groups.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    labels, _ = stored(whole.select("set_a", "set_b", F.coalesce("component", "node").alias("component")), "labels")
    labels = labels.withColumnsRenamed({"set_a": "a", "set_b": "b"})
    out = join_checked(rows.drop("keys", "bits"), labels, {"set_a": "a", "set_b": "b"}, "left", 48)
    # A row without shingles goes with the other rows of its id.
    bare = rows.where("n = 0 AND id IS NOT NULL").select(F.col("id").alias("of")).distinct().join(groups, F.col("of") == F.col("node")).select("of", F.col("component").alias("of_id"))
    bare, _ = stored(bare, "bare")
    out = join_checked(out, bare, {"id": "of"}, "left", 16)
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "of_id", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def without_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, whose id is the smallest of its component (see `near_duplicates`)."""
    gone, _ = stored(near_duplicates(df, id, text, **options).where(~F.col("kept")).select(F.col(id).alias("__gone")).distinct(), "gone")
    return join_checked(df, gone, {id: "__gone"}, "left_anti", 16)
