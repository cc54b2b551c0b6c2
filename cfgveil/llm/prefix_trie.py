"""The trie of conversation prefixes: who shares which opening turns.

A turn's id is 16 bytes wide, a conversation the bytes of its turns. The distinct sequences
are range-partitioned in byte order, and every range becomes an adaptive radix tree. A node
of the trie is a turn-aligned byte depth of that tree, inside a compressed path or at its
end. Neighbouring ranges share only the paths of the last sequence of one and the first of
the next; what they hold of those nodes are sums, which are added up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces
from cfgveil.llm.tables import drop, join_checked, parallelism, same, stored

WIDTH = 16  # bytes of a turn id: the first of a SHA-256
WORD = r"[^\x20\x09-\x0D]+"
RANGE_BYTES = 16 << 20  # of sequences in a tree
CHUNK = 16 << 10  # characters of a list of members that go on as one row
BATCH_BYTES = 4 << 20
NOBODY = hashlib.sha256(b"").hexdigest()


# The radix tree ---------------------------------------------------------------------


class Node:
    """A node whose layout grows with its children: 4, 16, 48, 256.

    Up to 16 children stand in byte order beside their bytes; 48 are found through an index of
    all bytes; 256 have a place for every byte. The node's compressed path is key[start:stop]
    of the key number `of`, its first byte included; `end` is the key that ends here, or -1.
    """

    __slots__ = ("layout", "letters", "kids", "of", "start", "stop", "end")

    def __init__(self, of: int, start: int, stop: int, end: int = -1) -> None:
        self.layout, self.letters, self.kids = 4, bytearray(), []
        self.of, self.start, self.stop, self.end = of, start, stop, end

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.letters.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.letters[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add a child, or put another in its place."""
        if self.layout <= 16:
            at = self.letters.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) == self.layout:
                self.grow()
                return self.put(byte, kid)
            at = sum(x < byte for x in self.letters)
            self.letters.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.layout == 48:
            at = self.letters[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) == 48:
                self.grow()
                self.put(byte, kid)
            else:
                self.kids.append(kid)
                self.letters[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for k, byte in enumerate(self.letters):
                index[byte] = k + 1
            self.layout, self.letters = 48, index
        else:
            self.layout, self.kids = 256, [self.kids[at - 1] if at else None for at in self.letters]
            self.letters = bytearray()

    def children(self) -> list[Node]:
        """In byte order."""
        if self.layout <= 16:
            return self.kids
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.letters if at]
        return [kid for kid in self.kids if kid is not None]


def common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many of `most` bytes from a[i] and b[j] on agree."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, high = 0, most  # the first `low` agree, the first `high` don't
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Byte strings, none twice, in an adaptive radix tree with compressed paths."""

    def __init__(self, keys: list[bytes]) -> None:
        self.keys = keys
        self.root = Node(0, 0, 0)
        for k in range(len(keys)):
            self.insert(k)

    def insert(self, k: int) -> None:
        key, node, at, parent = self.keys[k], self.root, 0, None
        while True:
            length = node.stop - node.start
            agree = common(self.keys[node.of], node.start, key, at, min(length, len(key) - at))
            if agree < length:  # the path is cut in two
                upper = Node(node.of, node.start, node.start + agree)
                node.start += agree
                upper.put(self.keys[node.of][node.start], node)
                parent.put(self.keys[upper.of][upper.start], upper)
                node = upper
            at += agree
            if at == len(key):
                node.end = k
                return
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Node(k, at, len(key), k))
                return
            parent, node = node, kid

    def bottom_up(self) -> list[Node]:
        """All nodes, children before their parents."""
        order, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            order.append(node)
            open_ += node.children()
        return order[::-1]


# The trie of a range ----------------------------------------------------------------

# `key` names a node that other ranges may hold too, `above` its parent if that is such a node.
NODES = "key binary, above binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ARROW = pa.schema([
    ("key", pa.binary()), ("above", pa.binary()), ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])


def range_nodes(keys: list[bytes], words: list[list[int]], n: list[int], least: list[int], ends: list[str], before: int, behind: int) -> list[tuple]:
    """The trie nodes of one range of distinct keys in byte order, as rows of NODES.

    For each key: the words of its turns, how many conversations it is, the smallest of them
    and the digest of all. `before` turns of the first key are shared with the key before the
    range, `behind` turns of the last with the key behind it; -1: there is none. Those nodes
    are partial: their numbers add up over the ranges (the smallest conv_id is the least), as
    a node, its words and its place among its parent's children count where it is first met.
    """
    tree = RadixTree(keys)
    first, last = keys[0], keys[-1]
    names = _names(first, before), _names(last, behind)
    # Of each radix node: members, smallest, leaves, sums of members x words and of words,
    # and the new trie nodes topmost in it.
    told: dict[int, tuple] = {}
    steps: dict[int, list[tuple]] = {}  # its trie nodes, deepest first
    for node in tree.bottom_up():
        kids = node.children()
        count = leaves = gross = net = tops = 0
        smallest = None
        for kid in kids:
            a, b, c, d, e, f = told[id(kid)]
            count, leaves, gross, net, tops = count + a, leaves + c, gross + d, net + e, tops + f
            smallest = b if smallest is None else min(smallest, b)
        if node.end >= 0:
            count += n[node.end]
            smallest = least[node.end] if smallest is None else min(smallest, least[node.end])
            if not kids and not (node.end == len(keys) - 1 and behind * WIDTH == len(last)):
                leaves += 1
        key, rows = keys[node.of], []
        low = node.start + 1 if node is not tree.root else 0  # a depth belongs to the path that reaches it
        with_first, with_last = _agree(key, first, before, node.start), _agree(key, last, behind, node.start)
        for depth in range(node.stop // WIDTH, -(-low // WIDTH) - 1, -1):
            on_first, on_last = depth <= with_first, depth <= with_last
            w = words[node.of][depth - 1] if depth else 0
            gross += count * w
            net += 0 if on_first else w
            end = ends[node.end] if node.end >= 0 and depth * WIDTH == node.stop else None
            name = names[0][depth] if on_first else names[1][depth] if on_last else None
            rows.append((depth, name, smallest, count, tops, leaves, gross - net, end))
            tops = 0 if on_first else 1
        told[id(node)] = (count, smallest, leaves, gross, net, tops)
        steps[id(node)] = rows
    out: list[tuple] = []
    open_ = [(tree.root, None, None)]  # with the parent of its first trie node: its name, if shared, and conv_id
    while open_:
        node, above, conv = open_.pop()
        for depth, name, smallest, count, kids, leaves, saved, end in reversed(steps[id(node)]):
            out.append((name, above, conv if above is None else None, smallest, depth, count, kids, leaves, saved, end))
            above, conv = name, smallest
        open_ += [(kid, above, conv) for kid in node.children()]
    return out


def _agree(key: bytes, edge: bytes, turns: int, start: int) -> int:
    """How many of the first `turns` turns of `edge` a key has; only asked where its path can reach them."""
    if turns * WIDTH < start:
        return -1
    return common(key, 0, edge, 0, min(len(key), turns * WIDTH)) // WIDTH


def _names(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1... `turns` turns."""
    out, running = [], hashlib.sha256()
    for d in range(turns + 1):
        if d:
            running.update(key[(d - 1) * WIDTH : d * WIDTH])
        out.append(running.copy().digest())
    return out


# The Spark jobs ---------------------------------------------------------------------


def rebuilt(df: DataFrame, conv: str, turn: str, role: str, text: str, group: int, heads: int) -> DataFrame:
    """(conv, turns array of (id, words)): the conversations that the trie is of."""
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), r.alias("role"), t.alias("text"))
    # The length of the role tells where the text begins, so no two turns are the same bytes.
    body = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    told = {"id": F.unhex(F.substring(F.sha2(body, 256), 1, 2 * WIDTH)), "words": F.regexp_count("text", F.lit(WORD)).cast("long")}
    slim = rows.withColumns(told)
    tied = slim.groupBy("conv", "turn").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(F.col("conv").alias("c"), F.col("turn").alias("t"))
    tied, path = stored(tied, "ties")
    slim = slim.withColumn("place", F.lit(0))
    if not tied.isEmpty():  # only rows of one turn number need their texts to be put in order
        of = same(slim["conv"], tied["c"]) & same(slim["turn"], tied["t"])
        place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
        slim = slim.join(tied, of, "left_anti").unionByName(slim.join(tied, of, "left_semi").withColumn("place", place))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "place", "id", "words")))
    own = slim.groupBy("conv").agg(F.transform(in_order, lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))
    own, own_path = stored(own, "conversations")
    drop(df.sparkSession, path)
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    giver = own.where(F.col("conv") % group == 0).select(F.col("conv").alias("giver"), F.slice("turns", 1, max(heads - 1, 1)).alias("head"))
    asked = own.withColumns({"h": taken, "of": F.col("conv") - F.col("conv") % group})
    met = asked.join(giver.hint("merge"), F.col("of") == F.col("giver"), "left")
    none = F.expr("array()").cast(own.schema["turns"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return met.select("conv", F.concat(head, rest).alias("turns")), own_path


def _sequence(turns: str) -> Column:
    return F.unhex(F.array_join(F.transform(F.col(turns), lambda x: F.hex(x["id"])), ""))


def member_lists(df: DataFrame, key: str, conv: str) -> DataFrame:
    """(key, n, least, ends): for each key its number of ids, the smallest, and the SHA-256 of
    the ids in numerical order, joined by commas.

    Ids are sorted in ranges, so a key of any frequency is spread; a key's ranges leave texts
    of at most CHUNK bytes, and only these meet, in order, to run through one digest.
    """
    rows = df.select(F.col(key).alias("key"), F.col(conv).alias("conv"))
    ordered = rows.repartitionByRange(4 * parallelism(df.sparkSession), "key", "conv").sortWithinPartitions("key", "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # key, first id, count, text
        for table in pieces(batches, BATCH_BYTES):
            keys = table["key"].to_pylist()
            ids = table["conv"].to_pylist()
            out = []
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < min(len(keys), start + CHUNK // 16) and keys[stop] == keys[start]:
                    stop += 1
                text = ",".join(map(str, ids[start:stop]))
                if open_ and open_[0] == keys[start] and len(open_[3]) < CHUNK:
                    open_[2] += stop - start
                    open_[3] += "," + text
                else:
                    if open_:
                        out.append(tuple(open_))
                    open_ = [keys[start], ids[start], stop - start, text]
                start = stop
            if out:
                yield _rows(out, kinds)
        if open_:
            yield _rows([tuple(open_)], kinds)

    kinds = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
    parts = ordered.mapInArrow(chunks, "key binary, least long, n long, text string")
    parts = parts.repartition("key").sortWithinPartitions("key", "least")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # key, count, smallest, running digest
        for table in pieces(batches, BATCH_BYTES):
            out = []
            for key, least, n, text in zip(*(table[c].to_pylist() for c in ("key", "least", "n", "text")), strict=True):
                if open_ and open_[0] == key:
                    open_[1] += n
                    open_[3].update(b"," + text.encode())
                else:
                    if open_:
                        out.append((*open_[:3], open_[3].hexdigest()))
                    open_ = [key, n, least, hashlib.sha256(text.encode())]
            if out:
                yield _rows(out, done)
        if open_:
            yield _rows([(*open_[:3], open_[3].hexdigest())], done)

    done = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    return parts.mapInArrow(digests, "key binary, n long, least long, ends string")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, group: int = 20, heads: int = 4, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every distinct opening of the rebuilt conversations, with what is known of its subtree.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    conv_id is the smallest conversation that opens so, parent_conv_id that of the opening one
    turn shorter. Conversation c is rebuilt from the first h turns of conversation c - c %
    `group` (the remainder has the sign of c) and its own turns behind its first h; h is the
    CRC-32 of c in decimal modulo `heads`.

    Turns are in order of turn (null first), then role, then text; null roles and texts count
    as empty, repeated rows are turns of their own. A conversation without turns after all is
    a member of the root. Rows with a null conv_id belong to no conversation and are left out.
    Other columns are not read. An empty table has no root: no rows.

    A conversation is one cell, 24 bytes a turn; the turns of different conversations meet in
    no task but by ranges of equal size, however many share their opening turns.
    """
    spark = df.sparkSession
    whole, own_path = rebuilt(df, conv, turn, role, text, group, heads)
    whole = whole.select("conv", _sequence("turns").alias("sequence"), F.col("turns.words").alias("words"))
    whole, whole_path = stored(whole.withColumn("name", F.unhex(F.sha2("sequence", 256))), "rebuilt")
    drop(spark, own_path)
    members, members_path = stored(member_lists(whole, "name", "conv"), "members")
    # The smallest member of each sequence stands for it.
    distinct = whole.join(members.hint("merge"), F.col("conv") == F.col("least")).select("sequence", "words", "n", "least", "ends")
    size = whole.agg(F.sum(F.octet_length("sequence") + 64)).first()[0] or 0
    ranges = max(parallelism(spark), -(-size // range_bytes))
    laid = distinct.repartitionByRange(int(ranges), "sequence").withColumn("range", F.spark_partition_id())
    laid, laid_path = stored(laid, "ranges")
    bounds = _shared(laid)

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence")
        k = table["range"][0].as_py()
        columns = [table[c].to_pylist() for c in ("sequence", "words", "n", "least", "ends")]
        rows = range_nodes(*columns, *bounds[k])
        return pa.Table.from_batches([_rows(rows, ARROW)])

    nodes, nodes_path = stored(laid.groupBy("range").applyInArrow(grow, NODES), "nodes")
    drop(spark, whole_path, members_path, laid_path)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = nodes.where("key is not null").groupBy("key").agg(F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    shared, shared_path = stored(shared, "shared")
    both = nodes.where("key is null").drop("key").unionByName(shared.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    of = shared.select(F.col("key").alias("of"), F.col("conv_id").alias("parent"))
    named = both.where("above is not null")
    named = join_checked(named, of, {"above": "of"}, "inner", 64).withColumn("parent_conv_id", F.col("parent"))
    every = both.where("above is null").drop("above").unionByName(named.drop("above", "of", "parent"))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")
    ).withColumnRenamed("conv_id", conv)


def _shared(laid: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range that has sequences: turns shared with the sequence before and behind it; -1: none.

    Two integers a range pass the driver; the sequences are compared in a task.
    """
    ends = laid.groupBy("range").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    ends, path = stored(ends, "ends")
    numbers = sorted(r["range"] for r in ends.select("range").collect())
    follows = laid.sparkSession.createDataFrame(list(zip(numbers[:-1], numbers[1:])), "range int, next int")
    after = ends.select(F.col("range").alias("next"), F.col("first").alias("then"))
    pairs = ends.join(follows, "range").join(after, "next").select("range", "next", "last", "then")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [common(a, 0, b, 0, min(len(a), len(b))) // WIDTH for a, b in zip(batch["last"].to_pylist(), batch["then"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["range"], batch["next"], pa.array(turns, pa.int64())], ["range", "next", "turns"])

    got = pairs.mapInArrow(measure, "range int, next int, turns long").collect()
    before, behind = {r["next"]: r["turns"] for r in got}, {r["range"]: r["turns"] for r in got}
    drop(laid.sparkSession, path)
    return {k: (before.get(k, -1), behind.get(k, -1)) for k in numbers}
