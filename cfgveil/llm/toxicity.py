"""Toxicity by a mined lexicon, matched with one typo allowed, in the light of its context."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cfgveil.llm.blocks import pieces
from cfgveil.llm.tables import drop, join_checked, stored

FEATURES = ("exact", "fuzzy", "quoted", "reported")
WINDOW = 4  # words before a hit that tell of its context
WORD = re.compile(r"[^\W_]+")
# Scripts that put no blanks between words (kana and Han): their words are pairs of neighbouring letters.
DENSE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
PARTS = re.compile(f"[{DENSE}]+|[^{DENSE}]+")
DENSE_LETTER = re.compile(f"[{DENSE}]")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters and digits, pairs in dense scripts."""
    out = []
    for word in WORD.findall(text.lower()):
        if word.isascii():
            out.append(word)
            continue
        for part in PARTS.findall(word):
            dense = len(part) > 1 and DENSE_LETTER.match(part)
            out += [part[k : k + 2] for k in range(len(part) - 1)] if dense else [part]
    return out


def _dense(codes: np.ndarray) -> np.ndarray:
    ranges = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF))
    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in ranges])


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts up to 3 as they are, then by doublings: 4 to 7 is 4, 8 to 15 is 5..."""
    return np.where(counts > 3, 2 + np.log2(np.maximum(counts, 1)).astype(np.int64), counts)


class LexiconAutomaton:
    """The trie of a lexicon intersected with Levenshtein automata, explored as words ask for it.

    A state is the set of (trie node, edits, swapped letter) triples that a prefix can be at;
    a trie node is a range of the sorted terms. Only nodes, states and steps that words have
    reached are held, and forgotten between two calls once there are more than `keep` steps:
    a lexicon of any size needs its terms and what the texts touch. `accept` is 0 for no term,
    1 for an exact term, 2 for one edit away (a letter put in, left out, exchanged, or two
    neighbours swapped). Terms shorter than `fuzzy_from` letters must match exactly.
    """

    def __init__(self, terms: list[str], fuzzy_from: int = 5, keep: int = 1 << 18) -> None:
        self.terms, self.keep = sorted(set(terms)), keep
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}  # 0: any other letter
        self.long = [0, *accumulate(len(t) >= fuzzy_from for t in self.terms)]  # how many before may be misspelled
        self.codes = np.array(sorted(ord(c) for c in self.letters), np.int64)
        self.forget()

    def forget(self) -> None:
        self.nodes, self.below = [(0, len(self.terms), 0)], {}  # (first term, end, depth), children by letter
        self.index, self.sets, self.accept, self.steps = {}, [], [], {}
        self.state(frozenset())
        self.state(self.closed({(0, 0, 0)}))

    def children(self, node: int) -> dict[int, int]:
        if node not in self.below:
            at, end, depth = self.nodes[node]
            at += len(self.terms[at]) == depth  # the term that ends here is the first
            out = {}
            while at < end:
                c = self.terms[at][depth]
                to = bisect_right(self.terms, c, at, end, key=lambda t: t[depth])
                out[self.letters[c]] = len(self.nodes)
                self.nodes.append((at, to, depth + 1))
                at = to
            self.below[node] = out
        return self.below[node]

    def fuzzy(self, node: int) -> bool:
        """Does a term that may be misspelled run through here?"""
        first, end, _ = self.nodes[node]
        return self.long[end] > self.long[first]

    def closed(self, triples: set[tuple]) -> frozenset:
        out = set(triples)
        for node, edits, swap in triples:
            if not edits and not swap:  # leave a letter out
                out |= {(child, 1, 0) for child in self.children(node).values() if self.fuzzy(child)}
        return frozenset(out)

    def after(self, state: frozenset, letter: int) -> frozenset:
        out = set()
        for node, edits, swap in state:
            if swap:  # the first of two swapped letters was read: now the other one
                if letter == swap:
                    out.add((node, 1, 0))
                continue
            if letter in self.children(node):
                out.add((self.children(node)[letter], edits, 0))
            if not edits and self.fuzzy(node):
                out.add((node, 1, 0))  # put in
                for own, child in self.children(node).items():
                    if own != letter and self.fuzzy(child):
                        out.add((child, 1, 0))  # exchanged
                        if letter in self.children(child):
                            out.add((self.children(child)[letter], 1, own))  # swapped, half way
        return self.closed(out)

    def state(self, triples: frozenset) -> int:
        if triples not in self.index:
            self.index[triples] = len(self.sets)
            self.sets.append(triples)
            exact = near = False
            for node, edits, swap in triples:
                first, _, depth = self.nodes[node]
                if not swap and len(self.terms[first]) == depth:
                    exact |= not edits
                    near |= edits and self.long[first + 1] > self.long[first]
            self.accept.append(1 if exact else 2 if near else 0)
        return self.index[triples]

    def step(self, key: int) -> int:
        """The state after state * (letters + 1) + letter."""
        if key not in self.steps:
            state, letter = divmod(key, len(self.letters) + 1)
            self.steps[key] = self.state(self.after(self.sets[state], letter))
        return self.steps[key]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The letter of each code point, 0 for those of no term."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 1, 0)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word codes[start:end] its `accept`; all words advance together, letter by letter."""
        if len(self.steps) > self.keep:
            self.forget()
        last, letter = np.zeros(len(starts), np.int64), self.classes(codes)
        live, state, at, end = np.arange(len(starts)), np.ones(len(starts), np.int64), starts.copy(), ends
        while len(live):
            done = at >= end
            last[live[done]] = state[done]
            go = ~done
            live, state, at, end = live[go], state[go], at[go], end[go]
            key, back = np.unique(state * (len(self.letters) + 1) + letter[at], return_inverse=True)
            state = np.array([self.step(k) for k in key.tolist()], np.int64)[back]
            go = state > 0
            live, state, at, end = live[go], state[go], at[go] + 1, end[go]
        return np.array(self.accept, np.int8)[last]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _is_letter() -> np.ndarray:
    """Code points below 0x3000 that are parts of words (letters and digits)."""
    return np.array([chr(c).isalnum() for c in range(0x3000)])


class Reader:
    """Features of texts: hits of the lexicon, and of these the quoted and the reported ones.

    A hit is quoted if an odd number of double quotes stands before it in its line and some
    after it, and reported if one of `window` words before it is among those that tell that
    somebody else speaks.
    """

    def __init__(self, terms: list[str], reporting: list[str] = (), window: int = WINDOW) -> None:
        self.automaton = LexiconAutomaton(terms) if terms else None
        self.reporting, self.letter, self.window = set(reporting), _is_letter(), window

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word, as `words_of` has them."""
        ink = self.letter[np.minimum(codes, 0x2FFF)].astype(np.int8)
        high = codes >= 0x3000
        if high.any():
            there, back = np.unique(codes[high], return_inverse=True)
            ink[high] = (np.array([chr(c).isalnum() for c in there.tolist()]) * (1 + _dense(there)))[back]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ink, [0]])))
        starts, ends = edge[:-1], edge[1:]
        kind = ink[starts] if len(starts) else ink[:0]
        starts, ends, kind = starts[kind > 0], ends[kind > 0], kind[kind > 0]
        if (kind == 2).any():
            pairs = np.where(kind == 2, np.maximum(ends - starts - 1, 1), 1)
            k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            dense, starts, ends = np.repeat(kind == 2, pairs), np.repeat(starts, pairs), np.repeat(ends, pairs)
            starts, ends = starts + k, np.where(dense, np.minimum(starts + k + 2, ends), ends)
        return starts, ends

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of every hit: the text it is in, its kind, whether it is quoted, and the words before it."""
        lowered = [(t or "").lower() for t in texts]
        joined = "\n".join(lowered)
        codes = _codes(joined)
        none = np.zeros(0, np.int64)
        if not self.automaton or not len(codes):
            return none, none, none.astype(bool), []
        starts, ends = self.spans(codes)
        kind = self.automaton.match(codes, starts, ends)
        at = np.flatnonzero(kind)
        text_ends = np.cumsum([len(t) + 1 for t in lowered])
        owner = np.searchsorted(text_ends, starts[at], side="right")
        # Quotes and line ends are counted once, so a line of any length costs its length.
        quotes, breaks = np.flatnonzero(np.isin(codes, QUOTES)), np.flatnonzero(codes == 10)
        line = np.searchsorted(breaks, starts[at])
        first, last = np.append(0, breaks + 1)[line], np.append(breaks, len(codes))[line]
        behind = np.searchsorted(quotes, last) - np.searchsorted(quotes, ends[at])
        before = np.searchsorted(quotes, starts[at]) - np.searchsorted(quotes, first)
        base = np.append(0, text_ends)[owner]
        context = [
            {joined[starts[w] : ends[w]] for w in range(max(0, h - self.window), h) if starts[w] >= b}
            for h, b in zip(at.tolist(), base.tolist(), strict=True)
        ]
        return owner, kind[at], (before % 2 == 1) & (behind > 0), context

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)), np.int64)
        owner, kind, quoted, context = self.hits(texts)
        reported = np.array([not c.isdisjoint(self.reporting) for c in context], bool)
        for column, chosen in enumerate((kind == 1, kind != 1, quoted, reported)):
            np.add.at(out[:, column], owner[chosen], 1)
        return out


QUOTES = [ord(c) for c in '"“”«»']


def mine_lexicon(labelled: DataFrame, *, min_docs: int = 5, min_share: float = 0.5, spread: float = 0.3) -> list[str]:
    """Words whose presence speaks for label 1, from rows (text, toxic).

    Counted over all rows: in how many documents of each label a word occurs. A term occurs in
    `min_docs` documents of label 1, and the share of label 1 among its documents is above
    `min_share` with confidence (lower Wilson bound at 1.96 deviations). Copies of one text
    say nothing new about their words: a term also follows at least `spread` times as many
    different words as it has documents of label 1 (counted up to 1000), and 4 at least. A word
    of one or two letters is a term only in a dense script. Every word that passes is a term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, 4 << 20):
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(table["text"].to_pylist(), table["toxic"].to_pylist(), strict=True):
                seen[label].update(set(words_of(text or "")))
            for label, counts in seen.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64()), pa.array([label] * len(counts), pa.int32())], ["word", "n", "label"])

    words = labelled.select("text", "toxic").mapInArrow(run, "word string, n long, label int")
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    n = F.col("bad") + F.col("good")
    long = (F.length("word") >= 3) | F.col("word").rlike(f"[{DENSE}]")
    chosen, path = stored(counts.where((F.col("bad") >= min_docs) & (_surely(F.col("bad"), n) > min_share) & long).select("word", "bad"), "terms")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, 4 << 20):
            found: set[tuple[str, str]] = set()
            for text in table["text"].to_pylist():
                words = words_of(text or "")
                found.update(zip(["", *words], words))  # noqa: B905
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found]), pa.array([zlib.crc32(v.encode()) for v, _ in found], pa.int64())], ["follower", "before"])

    pairs = labelled.where("toxic = 1").select("text").mapInArrow(neighbours, "follower string, before long")
    around = join_checked(pairs, chosen, {"follower": "word"}, "inner", 64).groupBy("word", "bad").agg(F.count_distinct("before").alias("n"))
    terms = around.where(F.col("n") >= F.greatest(F.lit(4.0), spread * F.least("bad", F.lit(1000)))).orderBy(F.desc("bad"), "word").collect()
    drop(labelled.sparkSession, path)
    return [r["word"] for r in terms]


def _surely(k: Column, n: Column, z: float = 1.96) -> Column:
    """A share that k of n is above with confidence: the lower Wilson bound."""
    share = k / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_reporting(labelled: DataFrame, terms: list[str], *, min_docs: int = 5, min_share: float = 0.5) -> list[str]:
    """Words before hits of the lexicon that speak for label 0: somebody else's words are told.

    Learned as the lexicon is, over all rows (text, toxic): in how many documents of each label
    a word stands before an exact hit (in `WINDOW` words). It is chosen if it does so in `min_docs`
    documents of label 0 and the share of label 0 is above `min_share` with confidence.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for table in pieces(batches, 1 << 20):
            labels, seen = table["toxic"].to_pylist(), Counter()
            owner, kind, _, context = reader.hits(table["text"].to_pylist())
            told = {(k, w) for k, exact, words in zip(owner.tolist(), (kind == 1).tolist(), context, strict=True) if exact for w in words}
            seen.update((w, labels[k]) for k, w in told)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen]), pa.array(list(seen.values()), pa.int64()), pa.array([y for _, y in seen], pa.int32())], ["word", "n", "label"])

    words = labelled.select("text", "toxic").mapInArrow(run, "word string, n long, label int")
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("all"))
    chosen = counts.where((F.col("good") >= min_docs) & (_surely(F.col("good"), F.col("all")) > min_share))
    return [r["word"] for r in chosen.orderBy("word").collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the intercept last) by Newton's method; rows are counted `weight` times."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", *, folds: int = 3, held: int = 1, threshold: float = 0.7, **mining) -> DataFrame:
    """Score every whole text; (id, held_out, score, predicted), one row for each row of `df`.

    Labels are learned only from ids whose crc32 as text modulo `folds` is not `held`. The
    lexicon is mined from all of these, then the words that tell of reported speech, and a
    logistic model is fitted to all of them, over counts by feature vector (hits, misspelled
    hits, quoted and reported hits, each beyond 3 on a scale of doublings, so their number grows
    with the logarithm of the longest text only). Lexicon and context words are held by every executor. Ids, labels, language and source are never
    part of a score.

    Null and empty texts get the score of a text without hits. Null labels teach nothing;
    several labels for one id all count; rows that share an id are scored one by one. Without
    any label of 1 every score is the smoothed share of label 1. Other columns are not read. An empty table
    gives an empty table.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    train_id = F.pmod(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")), F.lit(folds)) != held
    known = labels.select(F.col(f"`{id}`").alias("of"), F.col(f"`{label}`").cast("int").alias("toxic")).where("toxic IN (0, 1) AND of IS NOT NULL")
    known, known_path = stored(known, "labels")
    taught = join_checked(docs.where(train_id), known, {"id": "of"}, "inner", 16).select("text", "toxic")
    terms = mine_lexicon(taught, **mining)
    reporting = mine_reporting(taught, terms) if terms else []
    sent = spark.sparkContext.broadcast((terms, reporting))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(*sent.value), Counter()
        for table in pieces(batches, 1 << 20):
            vectors = levels(reader.features(table["text"].to_pylist()))
            seen.update((int(y), *v) for y, v in zip(table["toxic"].to_pylist(), vectors.tolist(), strict=True))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*((*k, n) for k, n in seen.items()), strict=True)], ["toxic", *FEATURES, "n"])

    spec = ", ".join(f"{c} long" for c in ("toxic", *FEATURES, "n"))
    table = taught.mapInArrow(counted, spec).groupBy("toxic", *FEATURES).agg(F.sum("n").alias("n")).collect()
    rows = np.array([tuple(r) for r in table], np.float64).reshape(-1, len(FEATURES) + 2)
    rows = rows[np.lexsort(rows.T)]
    w = fit_logistic(rows[:, 1:-1], rows[:, 0], rows[:, -1]) if len(rows) else np.zeros(len(FEATURES) + 1)
    drop(spark, known_path)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value)
        for part in pieces(batches, 1 << 20):
            vectors = levels(reader.features(part["text"].to_pylist()))
            score = 1 / (1 + np.exp(-(vectors @ w[:-1] + w[-1])))
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(score)], ["id", "score"])

    marks = docs.withColumn("id", F.col("id").cast("long")).mapInArrow(scored, "id long, score double")
    held_out = F.coalesce(~train_id, F.lit(False))
    return marks.select(F.col("id").alias(id), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
