"""A hierarchical Pitman-Yor language model over the whole corpus.

Every word is a restaurant: its customers are the tokens that follow it. The end of a text
is the word before the next one's start. All restaurants share one parent, the unigram
restaurant, whose base is uniform. Of order 3 every couple of words is a restaurant too, below
that of its second word, and what that one serves are the couples' tables (a text starts after
two ends). Blocks of documents send the hash shards their distinct (context, word[, word before
the context]) with training counts, by context: a shard seats a word's restaurant and all that
are below it by Gibbs sweeps (the largest are split by word). The tables of each word then meet
in shards of words, which seat the parent, and so do the tables of couples that were split. A
block is answered by both: pairs and restaurants by the first, words and split couples by the
second.

Words travel as 64-bit hashes, the most frequent ones as their places in a book of codes.
The book only makes packets small: no result tells words in it from words that are not, but
for the parent's probabilities while restaurants are seated (see `Shard`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.blocks import BLOCK_BYTES, NO_ID, ask, ids, n_shards, pack, pieces, settle, unpack, utf8, write_blocks
from cfgveil.llm.tables import parallelism, stored
from cfgveil.llm.words import Powers, U, hash_words, mix, spans

END = U(0x2545F4914F6CDD1D)  # the token after a text's last word
BOOK = 1 << 17  # words that travel as codes
REPORTED = 3  # times in a block that make a word a candidate for the book
# A restaurant is split by word if it has more than one in so many customers of a shard.
SPLIT = 4
WORD_SHARDS = 4  # shards of contexts for one of words
SAMPLES, BURN_IN = 3, 3
# Discount and strength of the context restaurants, and of the shared parent.
CONTEXT, ROOT = (0.75, 1.0), (0.6, 10.0)
SEATING_BASE = 1e-6  # base probability while the parent's customers are seated


def tokens(table: pa.Table, id: str, text: str, folds: int, held: int) -> tuple[np.ndarray, ...]:
    """(ids, first token of each text and the end, word hashes with ends, held out)."""
    data, offsets = utf8(table[text])
    starts, ends, first = spans(data, offsets)
    h = hash_words(data, starts, ends, Powers())
    n = len(offsets) - 1
    at = first[1:] + np.arange(n)  # place of each text's end token
    words = np.empty(len(h) + n, U)
    is_end = np.zeros(len(words), bool)
    is_end[at] = True
    words[is_end] = END
    words[~is_end] = h
    doc = ids(table[id])
    names = ["" if d == NO_ID else str(d) for d in doc.tolist()]
    held_out = np.array([bool(x) and zlib.crc32(x.encode()) % folds == held for x in names], bool)
    return doc, np.append(first[:-1] + np.arange(n), len(words)).astype(np.int64), words, held_out


def listed(**arrays: np.ndarray) -> pa.Table:
    """Arrays of any lengths as one row."""
    return pa.table({k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), pa.array(v)) for k, v in arrays.items()})


def arrays_of(table: pa.Table) -> dict[str, np.ndarray]:
    return {k: table[k].combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in table.column_names}


def planes(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Whole numbers by bytes, which compress apart; high bytes that are all zero are left out."""
    parts = x.astype("<i8").view(np.uint8).reshape(-1, 8)
    return {f"{name}{j}": np.ascontiguousarray(parts[:, j]) for j in range(8) if j == 0 or parts[:, j].any()}


def numbers(a: dict[str, np.ndarray], name: str) -> np.ndarray:
    out = np.zeros((len(a[f"{name}0"]), 8), np.uint8)
    for j in range(8):
        if f"{name}{j}" in a:
            out[:, j] = a[f"{name}{j}"]
    return out.reshape(-1).view("<i8")


class Book:
    """Codes of frequent words, by falling frequency; the code after the last stands for any other word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        self.words = np.append(words, U(0))
        self.counts = np.append(counts, 0).astype(np.float64)
        self.order = np.argsort(words).astype(np.int64)
        self.ordered = words[self.order]

    def codes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.order):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.ordered, words), len(self.order) - 1)
        return np.where(self.ordered[at] == words, self.order[at], len(self.order))

    def written(self, name: str, words: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
        return planes(name, codes) | {f"{name}x": words[codes == len(self.order)].view(np.int64)}

    def read(self, name: str, a: dict[str, np.ndarray]) -> np.ndarray:
        codes = numbers(a, name)
        words = self.words[codes]
        words[codes == len(self.order)] = a[f"{name}x"].view(U)
        return words


def numbered(book: Book, name: str, packets: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of `name` in packets, as numbers and by number; only words that aren't in the book are sorted."""
    codes, n = np.concatenate([numbers(a, name) for a in packets]), len(book.order)
    others, at = np.unique(np.concatenate([a[f"{name}x"] for a in packets]).view(U), return_inverse=True)
    codes[codes == n] = n + at
    there = np.zeros(n + len(others), bool)
    there[codes] = True
    return (np.cumsum(there, dtype=np.int32) - 1)[codes], np.append(book.words[:n], others)[there]


class Tokens:
    """The distinct words of a block and, of order 3, its distinct (context, word before) of split contexts, by their shards."""

    def __init__(self, a: dict[str, np.ndarray], book: Book, split: np.ndarray, word_shards: int, order: int) -> None:
        self.words, self.codes = book.read("w", a), numbers(a, "w")
        self.back = back = numbers(a, "at").astype(np.int32)
        end = np.flatnonzero(self.words == END)[0]
        self.before = np.empty_like(back)  # every text ends with END, and so does what stands before the first
        self.before[1:] = back[:-1]
        self.before[:1] = end
        self.apart = np.isin(self.words, split)
        word_shard = (mix(self.words ^ END) % U(word_shards)).astype(np.int64)
        self.by_shard = np.argsort(word_shard, kind="stable")
        self.word_ends = np.searchsorted(word_shard[self.by_shard], np.arange(word_shards + 1))
        key = np.zeros(0, np.int64)
        if order == 3:
            self.farther = np.empty_like(back)  # the word before the context
            self.farther[1:] = self.before[:-1]
            self.farther[self.before == end] = end
            here = self.apart[self.before]
            key = np.unique(self.before[here].astype(np.int64) * len(self.words) + self.farther[here])
        of, far = np.divmod(key, max(1, len(self.words)))
        couple_shard = (couples(self.words[of], self.words[far]) % U(word_shards)).astype(np.int64)
        self.by_couple_shard = np.argsort(couple_shard, kind="stable")
        self.couple_ends = np.searchsorted(couple_shard[self.by_couple_shard], np.arange(word_shards + 1))
        self.couples, self.couple_context, self.couple_far = key, of, far
        self.asked = np.flatnonzero((np.diff(self.word_ends) > 0) | (np.diff(self.couple_ends) > 0)).tolist()


class Pairs(Tokens):
    """Also the distinct (shard, context, word) of a block, ordered, and those with the word before the context."""

    def __init__(self, a: dict[str, np.ndarray], book: Book, split: np.ndarray, shards: int, word_shards: int, order: int) -> None:
        super().__init__(a, book, split, word_shards, order)
        v = len(self.words)
        key = self.before.astype(np.int64) * v + self.back
        if order == 3:
            if v >= 1 << 21:  # the three don't fit in 63 bits
                key = np.unique(key, return_inverse=True)[1]
            key = key * v + self.farther
        key, at = np.unique(key, return_inverse=True)
        of = lambda x: scattered(at, x, len(key))
        context, word = of(self.before), of(self.back)
        spread = np.where(self.apart[context], self.words[word] * U(0x9E3779B97F4A7C15), U(0))
        shard = (mix(self.words[context] + spread) % U(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int32)  # of each as it is sent
        place[by] = np.arange(len(by))
        context, word, shard = context[by], word[by], shard[by].astype(np.int64)
        new = np.ones(len(by), bool)  # first of a pair
        new[1:] = (shard[1:] != shard[:-1]) | (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        self.pair = np.cumsum(new, dtype=np.int32) - 1
        self.long_at = place[at]  # of each token
        self.at = self.pair[self.long_at]
        if order == 3:
            self.far = of(self.farther)[by]
        self.shard, self.context, self.word = shard[new], context[new], word[new]
        self.new = np.ones(len(self.word), bool)  # first pair of a context in a shard
        self.new[1:] = (self.shard[1:] != self.shard[:-1]) | (self.context[1:] != self.context[:-1])
        self.cuts = cuts(self.shard)


def scattered(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """What `x` holds for each of `n` places; entries of one place are equal."""
    out = np.empty(n, x.dtype)
    out[at] = x
    return out


def couples(contexts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One hash for a context and the word before it."""
    return mix(mix(before) + contexts * U(0x9E3779B97F4A7C15))


def parted(x: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """`x` in pieces as long as those of `like`."""
    return np.split(x, np.cumsum([len(y) for y in like])[:-1])


def cuts(shard: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers."""
    edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers one by one.

    The next customer opens a table with probability pull / (pull + seated - discount * tables),
    where `pull` is the parent's predictive probability times (strength + discount * tables of
    the restaurant). After 64 customers they come in groups that double in size, each with the
    probability at its beginning.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    live = live[np.argsort(-customers[live], kind="stable")]  # those that have more to seat come first
    c, q, t = customers[live], pull[live], np.ones(len(live))
    seated, n = 1, len(live)
    while n:
        p = q[:n] / (q[:n] + seated - discount * t[:n])
        t[:n] += rng.random(n) < p if seated < 64 else rng.binomial(np.minimum(seated, c[:n] - seated).astype(np.int64), p)
        seated += 1 if seated < 64 else seated
        n = int(np.searchsorted(-c[:n], -seated))
    tables[live] = t
    return tables


def seat_shared(customers: np.ndarray, shared: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """`seat`, given the dishes of more than one customer and their pulls alone: any other has as many tables as customers."""
    tables = (customers > 0).astype(np.float64)
    tables[shared] = seat(customers[shared], pull, discount, rng)
    return tables


class Shard:
    """The restaurants of one shard, seated.

    A restaurant is here whole, so its tables are known. One that is split by word has about
    one in `shards` of its tables here, and of the other dishes' tables of a couple with such
    a context. While restaurants are seated, the parent's tables of a
    word are those of this shard times what the book's count of the word is to its count here;
    a word that isn't in the book, and so opens hardly any second table, counts with those of
    this shard alone. What is answered in the end is counted over all shards.
    """

    def __init__(
        self, number: int, shards: int, packets: list[bytes], book: Book, split: np.ndarray, total: int, samples: int, burn_in: int, order: int
    ) -> None:
        asked = [arrays_of(unpack(p)) for p in packets]
        self.longer = order == 3
        self.places, self.contexts = numbered(book, "c", asked)
        asked_word, self.words = numbered(book, "w", asked)
        sizes, n = [numbers(a, "size") for a in asked], [numbers(a, "n") for a in asked]
        self.ends = np.cumsum([[len(x), x.sum(), len(y)] for x, y in zip(sizes, n, strict=True)], axis=0)[:-1].T  # of packets
        asked_context, n = np.repeat(self.places, np.concatenate(sizes)), np.concatenate(n).astype(np.float64)
        key = asked_context.astype(np.int64) * len(self.words) + asked_word
        if self.longer:
            far, self.fars = numbered(book, "u", asked)
            each = np.concatenate([numbers(a, "each") for a in asked])
            if len(self.contexts) * len(self.words) * len(self.fars) >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
            key, back = np.unique(np.repeat(key, each) * len(self.fars) + far, return_inverse=True)
            self.long_back = back.astype(np.int32)
            far = scattered(self.long_back, far, len(key))
            key //= len(self.fars)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            pair = np.cumsum(new, dtype=np.int32) - 1
            self.back, pairs = pair[self.long_back[np.cumsum(each) - each]], int(pair[-1]) + 1
            del back, each, new
        else:
            key, self.back = np.unique(key, return_inverse=True)
            pairs = len(key)
        del asked, key, sizes
        context, word = scattered(self.back, asked_context, pairs), scattered(self.back, asked_word, pairs)
        del asked_context, asked_word
        self.split = np.isin(self.contexts, split)
        if self.longer:
            self.couples, couple = np.unique(context[pair].astype(np.int64) * len(self.fars) + far, return_inverse=True)
            self.couple = couple = couple.astype(np.int32)
            self.long_n = np.bincount(self.long_back, weights=n, minlength=len(pair))
            self.n = np.bincount(pair, weights=self.long_n, minlength=pairs)
            long_shared = np.flatnonzero(self.long_n > 1)
            their_pair, their_couple = pair[long_shared], couple[long_shared]
            long_tables, couple_room = (self.long_n > 0).astype(np.float64), np.zeros(len(self.couples))
            self.long_tables, self.couple_room = np.zeros(len(pair)), np.zeros(len(self.couples))
        else:
            self.n = np.bincount(self.back, weights=n, minlength=pairs)
        del n
        customers = np.bincount(pair, weights=long_tables, minlength=pairs) if self.longer else self.n
        self.here = np.bincount(word, weights=self.n, minlength=len(self.words))
        known = book.counts[book.codes(self.words)]
        scale = np.maximum(known / np.maximum(self.here, 1), 1)
        others = np.where(self.split, shards, 1.0)
        rng = np.random.default_rng(number)
        (d, s), (d0, s0) = CONTEXT, ROOT
        parent = (self.here * scale + 0.1) / max(1, total)
        room, tables = np.zeros(len(self.contexts)), (customers > 0).astype(np.float64)
        self.tables, self.served = np.zeros(len(context)), []
        self.customers, self.room, self.present = np.zeros(len(context)), np.zeros(len(self.contexts)), np.zeros(len(self.contexts))
        for sweep in range(burn_in + samples):
            if self.longer:
                there, x = others[context[their_pair]], their_pair
                present = np.bincount(context, weights=customers, minlength=len(self.contexts))
                likely = customers[x] - d * tables[x] + (s + d * (others * room)[context[x]]) * parent[word[x]]
                likely = likely / (s + (others * present)[context[x]])
                own = long_tables[long_shared]
                pull = (s + d * (own + there * np.maximum(couple_room[their_couple] - own, 0))) * likely
                long_tables = seat_shared(self.long_n, long_shared, pull, d, rng)
                couple_room = np.bincount(couple, weights=long_tables, minlength=len(self.couples))
                customers = np.bincount(pair, weights=long_tables, minlength=len(context))
            shared = np.flatnonzero(customers > 1)
            c = context[shared]
            tables = seat_shared(customers, shared, (s + d * (others * room)[c]) * parent[word[shared]], d, rng)
            room = np.bincount(context, weights=tables, minlength=len(self.contexts))
            own = np.bincount(word, weights=tables, minlength=len(self.words))
            served = np.rint(own * scale)
            root = seat(served, np.full(len(served), s0 * SEATING_BASE + d0 * SEATING_BASE * shards * len(served)), d0, rng)
            all_served = total * own.sum() / max(1, self.n.sum())
            parent = np.maximum((served - d0 * root + (s0 + d0 * root.sum() * shards) / (len(served) * shards + 1)) / (s0 + all_served), 1e-12)
            if sweep >= burn_in:
                self.tables += tables
                self.room += room
                self.served.append(own)
                if self.longer:
                    self.customers += customers
                    self.present += np.bincount(context, weights=customers, minlength=len(self.contexts))
                    self.long_tables += long_tables
                    self.couple_room += couple_room

    def replies(self) -> Iterator[pa.Table]:
        """For each packet its pairs' customers and tables, and its contexts' tables; of order 3 those of longer contexts too (sums over the samples)."""
        for c, at, long in zip(*(np.split(x, e) for x, e in zip((self.places, self.back, self.long_back if self.longer else self.back), self.ends, strict=True)), strict=True):
            reply = planes("n", self.n[at]) | planes("t", self.tables[at]) | planes("room", self.room[c])
            if self.longer:
                reply |= planes("s", self.customers[at]) | planes("present", self.present[c])
                reply |= planes("ln", self.long_n[long]) | planes("lt", self.long_tables[long]) | planes("lroom", self.couple_room[self.couple[long]])
            yield listed(**reply)

    def split_couples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word before, tables) of the couples with a split context that have tables here."""
        if not self.longer:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0)
        context, far = np.divmod(self.couples, len(self.fars))
        k = np.flatnonzero(self.split[context] & (self.couple_room > 0))
        return self.contexts[context[k]], self.fars[far[k]], self.couple_room[k]


def score(
    df: DataFrame, id: str = "doc_id", text: str = "text", *, order: int = 2, folds: int = 10, held: int = 0, samples: int = SAMPLES, burn_in: int = BURN_IN,
    shard_bytes: int = 16 << 20, block_bytes: int = BLOCK_BYTES, book_words: int = BOOK,
) -> DataFrame:
    """Score every whole text with a model of the texts that are not held out.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for
    each row of `df`. Held out are ids whose crc32 as text modulo `folds` is `held`. Tokens:
    words without spaces and x09-x0D, A-Z lower-cased, then one end; n_known of them occur in
    training. base_score is the add-0.1 unigram log10 probability, score the model's, with
    tables averaged over the kept seatings; the perplexity of a text is 10 ** (-score / n_tokens).
    Every word, however rare, has a restaurant of its own, and of `order` 3 every couple of words.

    A null or empty text is its end token alone. A null id is never held out. Rows that share
    an id all count. Words unknown to training share one place in the vocabulary. Other
    columns of `df` are not read. An empty table gives an empty table. `book_words`: words
    that travel as codes.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order}: two words or three")
    spark = df.sparkSession
    narrow = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, block_bytes):
            _, first, words, held_out = tokens(table, "id", "text", folds, held)
            taught = words[~np.repeat(held_out, np.diff(first))]
            word, n = np.unique(taught, return_counts=True)
            often = (n >= REPORTED) | (n * BOOK >= len(taught))
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["word", "n"])

    counted = narrow.mapInArrow(candidates, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(book_words).toArrow()
    top_words, top_counts = top["word"].to_numpy().view(U), top["n"].to_numpy()
    sent = spark.sparkContext.broadcast(Book(top_words, top_counts))

    def coded(table: pa.Table) -> dict:
        doc, first, words, held_out = tokens(table, "id", "text", folds, held)
        words, back = np.unique(words, return_inverse=True)
        size, book, codes = np.diff(first), sent.value, sent.value.codes(words)
        by = np.argsort(codes, kind="stable")  # neighbours' codes are alike, and compress
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        body = listed(id=doc, null=table["id"].is_null().to_numpy(), held_out=held_out, size=size, **book.written("w", words[by], codes[by]), **planes("at", place[back]))
        return {"tokens": int(size[~held_out].sum()), "body": pack(body)}

    blocks, _ = write_blocks(narrow, block_bytes, "tokens long", coded)
    if blocks.isEmpty():
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    shards = n_shards(blocks, shard_bytes)
    word_shards = max(parallelism(spark), shards // WORD_SHARDS)
    total = blocks.agg(F.sum("tokens")).first()[0]
    split = np.sort(top_words[top_counts * SPLIT * shards >= total])  # at most SPLIT * shards

    def opened(table: pa.Table) -> tuple[dict[str, np.ndarray], Pairs, np.ndarray]:
        """(arrays of the block, its pairs, whether each token is taught)."""
        a = arrays_of(table)
        return a, Pairs(a, sent.value, split, shards, word_shards, order), ~np.repeat(a["held_out"], a["size"])

    def pairs_asked(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, p, learned = opened(table)
        n = np.bincount(p.long_at, weights=learned, minlength=len(p.pair))
        for a, b in p.cuts:
            new = np.flatnonzero(p.new[a:b])
            c, w = p.context[a:b][new], p.word[a:b]
            written = sent.value.written("c", p.words[c], p.codes[c]) | sent.value.written("w", p.words[w], p.codes[w])
            k = slice(*np.searchsorted(p.pair, [a, b]))
            if order == 3:
                written |= planes("each", np.bincount(p.pair[k] - a, minlength=b - a)) | sent.value.written("u", p.words[p.far[k]], p.codes[p.far[k]])
            yield int(p.shard[a]), pack(listed(**written, **planes("size", np.diff(new, append=b - a)), **planes("n", n[k])))

    def words_asked(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        a, book = arrays_of(table), sent.value
        t = Tokens(a, book, split, word_shards, order)
        n = np.bincount(t.back, weights=~np.repeat(a["held_out"], a["size"]), minlength=len(t.words))
        for x in t.asked:
            w = t.by_shard[t.word_ends[x] : t.word_ends[x + 1]]
            k = t.by_couple_shard[t.couple_ends[x] : t.couple_ends[x + 1]]
            c, u = t.couple_context[k], t.couple_far[k]
            of_couples = book.written("c", t.words[c], t.codes[c]) | book.written("u", t.words[u], t.codes[u])
            yield x, pack(listed(**book.written("w", t.words[w], t.codes[w]), **planes("n", n[w]), **of_couples))

    seated_schema = "kind string, shard long, block long, body binary"

    def seat_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        number, book = table["shard"][0].as_py(), sent.value
        shard = Shard(number, shards, table["body"].to_pylist(), book, split, total, samples, burn_in, order)
        rows = [{"kind": "pairs", "shard": number, "block": b, "body": pack(x)} for b, x in zip(table["block"].to_pylist(), shard.replies(), strict=True)]
        k = shard.split
        apart = {"context": shard.contexts[k].view(np.int64), "room": shard.room[k], "present": shard.present[k]}
        rows.append({"kind": "split", "shard": number, "block": 0, "body": pack(listed(**apart))})
        known = np.flatnonzero(shard.here)
        to = (mix(shard.words[known] ^ END) % U(word_shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        known, ends = known[by], np.searchsorted(to[by], np.arange(word_shards + 1))
        contexts, fars, rooms = shard.split_couples()
        to = (couples(contexts, fars) % U(word_shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        contexts, fars, rooms, far_ends = contexts[by], fars[by], rooms[by], np.searchsorted(to[by], np.arange(word_shards + 1))
        for x in np.flatnonzero((np.diff(ends) > 0) | (np.diff(far_ends) > 0)).tolist():
            w, k = known[ends[x] : ends[x + 1]], slice(far_ends[x], far_ends[x + 1])
            words = shard.words[w]
            tables = {key: v for i, y in enumerate(shard.served) for key, v in planes(f"x{i}_", y[w]).items()}
            of_couples = book.written("c", contexts[k], book.codes(contexts[k])) | book.written("u", fars[k], book.codes(fars[k])) | planes("room", rooms[k])
            rows.append({"kind": "words", "shard": x, "block": number, "body": pack(listed(**book.written("w", words, book.codes(words)), **tables, **of_couples))})
        return pa.Table.from_pylist(rows, schema=pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())]))

    seated, _ = stored(ask(blocks, pairs_asked).groupBy("shard").applyInArrow(seat_shard, seated_schema), "seated", blobs=True)

    told_schema = "shard long, block long, body binary, words long, served double, roots double"

    def seat_words(table: pa.Table) -> pa.Table:
        """The parent's customers and tables of the words of one shard; answers by block, then the shard's totals."""
        table = table.sort_by([("kind", "ascending"), ("block", "ascending")])
        number, book = table["shard"][0].as_py(), sent.value
        is_ask = np.array([k == "ask" for k in table["kind"].to_pylist()])
        bodies = table["body"].to_pylist()
        asked = [arrays_of(unpack(x)) for x, yes in zip(bodies, is_ask, strict=True) if yes]
        read = [book.read("w", a) for a in asked]
        words, back = np.unique(np.concatenate(read), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([numbers(a, "n") for a in asked]), minlength=len(words))
        keys = [couples(book.read("c", a), book.read("u", a)) for a in asked]
        known, couple_back = np.unique(np.concatenate(keys), return_inverse=True)
        rooms = np.zeros(len(known))
        served = np.zeros((samples, len(words)))
        for x, yes in zip(bodies, is_ask, strict=True):
            if not yes:
                a = arrays_of(unpack(x))
                at = np.searchsorted(words, book.read("w", a))
                for i in range(samples):
                    served[i, at] += numbers(a, f"x{i}_")
                rooms[np.searchsorted(known, couples(book.read("c", a), book.read("u", a)))] += numbers(a, "room")
        d0, s0 = ROOT
        pull = np.full(len(words), s0 * SEATING_BASE + d0 * SEATING_BASE * word_shards * len(words))
        root = np.stack([seat(x, pull, d0, np.random.default_rng([7, number, i])) for i, x in enumerate(served)])
        left = (served - d0 * root).mean(axis=0).astype(np.float32)
        rows = [
            {"shard": shards + number, "block": b, "body": pack(listed(**planes("n", count[at]), left=left[at], **planes("room", rooms[k])))}
            for b, at, k in zip(table["block"].to_numpy()[is_ask].tolist(), parted(back, read), parted(couple_back, keys), strict=True)
        ]
        rows.append({"shard": number, "words": int((count > 0).sum()), "served": float(served.mean(axis=0).sum()), "roots": float(root.mean(axis=0).sum())})
        kinds = [("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("words", pa.int64()), ("served", pa.float64()), ("roots", pa.float64())]
        return pa.Table.from_pylist(rows, schema=pa.schema(kinds))

    met = ask(blocks, words_asked).select(F.lit("ask").alias("kind"), "shard", "block", "body").unionByName(seated.where("kind = 'words'"))
    told, _ = stored(met.groupBy("shard").applyInArrow(seat_words, told_schema), "words", blobs=True)
    sums = told.agg(F.sum("words"), F.sum("served"), F.sum("roots")).first()
    vocabulary, all_served, roots = sums[0], sums[1], sums[2]

    def rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("body"):
                a = arrays_of(unpack(x.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(a[k]) for k in ("context", "room", "present")], ["context", "room", "present"])

    # The tables and customers of the split restaurants over all shards: as many rows as `split` has.
    parts = seated.where("kind = 'split'").select("body").mapInArrow(rooms, "context long, room double, present double")
    whole = parts.groupBy("context").agg(F.sum("room").alias("room"), F.sum("present").alias("present")).toArrow()
    by = np.argsort(whole["context"].to_numpy().view(U))
    split_words = whole["context"].to_numpy().view(U)[by]
    split_rooms, split_present = whole["room"].to_numpy()[by], whole["present"].to_numpy()[by]

    def use(table: pa.Table, replies: list[bytes]) -> pa.Table:
        a, p, _ = opened(table)
        answers = [arrays_of(unpack(r)) for r in replies]
        of_pairs, of_words = answers[: len(p.cuts)], answers[len(p.cuts) :]
        gather = lambda xs, name: np.concatenate([numbers(x, name) for x in xs])
        n, t, met = gather(of_pairs, "n"), gather(of_pairs, "t"), gather(of_pairs, "room")
        count, left, room = np.zeros(len(p.words), np.int64), np.zeros(len(p.words)), np.zeros(len(p.words))
        if len(n) != len(p.word) or sum(len(x["left"]) for x in of_words) != len(p.words):
            raise ValueError("replies do not match the block")
        count[p.by_shard], left[p.by_shard] = gather(of_words, "n"), np.concatenate([x["left"] for x in of_words])
        room[p.context[p.new]] = met
        served, present = n, count  # as many follow a word as it occurs
        if order == 3:
            served, present = gather(of_pairs, "s") / samples, np.zeros(len(p.words))
            present[p.context[p.new]] = gather(of_pairs, "present")
        if len(split_words):
            at = np.minimum(np.searchsorted(split_words, p.words), len(split_words) - 1)
            is_split = split_words[at] == p.words
            room = np.where(is_split, split_rooms[at], room)
            present = np.where(is_split, split_present[at], present) if order == 3 else present
        present = present / samples if order == 3 else present
        (d, s), (d0, s0) = CONTEXT, ROOT
        parent = (left + (s0 + d0 * roots) / (vocabulary + 1)) / (s0 + all_served)
        c = p.context
        likely = (served - d * t / samples + (s + d * room[c] / samples) * parent[p.word]) / (s + present[c])
        token = p.long_at
        if order == 3:
            long_n, long_t, long_room = gather(of_pairs, "ln"), gather(of_pairs, "lt"), gather(of_pairs, "lroom").astype(np.float64)
            couple_room = np.zeros(len(p.couples))
            couple_room[p.by_couple_shard] = gather(of_words, "room")
            of, apart = p.context[p.pair], p.apart[p.context[p.pair]]
            long_room[apart] = couple_room[np.searchsorted(p.couples, of[apart].astype(np.int64) * len(p.words) + p.far[apart])]
            # As many follow a couple as it occurs, and two ends, where a text starts, as an end does.
            met = np.zeros(len(p.pair))
            met[token] = np.where(p.words[p.before] == END, count[p.before], n[np.append(p.at[:1], p.at[:-1])])
            likely = (long_n - d * long_t / samples + (s + d * long_room / samples) * likely[p.pair]) / (s + met)
        base = np.log10((count + 0.1) / (total + 0.1 * (vocabulary + 1)))
        first = np.cumsum(a["size"], dtype=np.int64) - a["size"]
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return pa.table({
            "id": pa.array(a["id"], mask=a["null"]), "held_out": pa.array(a["held_out"]), "n_tokens": pa.array(a["size"].astype(np.int64)), "n_known": pa.array(add((count > 0)[p.back].astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(first), total, np.int64)), "base_score": pa.array(add(base[p.back])), "score": pa.array(add(np.log10(likely)[token])),
        })

    answers = seated.where("kind = 'pairs'").select("shard", "block", "body").unionByName(told.where("body is not null").select("shard", "block", "body"))
    return settle(blocks, answers, use, schema).withColumnRenamed("id", id)
