"""Quality, packing, decontamination, chat, language model, sharding, toxicity, pipeline."""

import base64
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from cfgveil.llm import chat, oracle, packing, pitman_yor, queries
from cfgveil.llm.chat import assemble, format_chats, parse, unescape
from cfgveil.llm.decontamination import RADIUS, HammingIndex, contaminated, without_benchmark
from cfgveil.llm.host_rules import host_verdicts, keep_good, quality
from cfgveil.llm.packing import bucket_bounds, pack, token_counts
from cfgveil.llm.sharding import balanced_shards, write_shards
from cfgveil.llm.toxicity import LexiconAutomaton, Reader, _codes, mine_lexicon, mine_reporting, toxicity, words_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_sql_twins(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(oracle.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in queries.QUERIES}
    assert "pipeline" in entry.queries() and set(oracle.SQL) <= set(entry.oracle_sql())


def test_quality_edges(edges, empty):
    rows = {(r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality(edges).collect()}
    assert {(1, 0, 0, 0, 0, False), (2, 0, 0, 0, 0, False), (6, 1, 300_000, 0, 0, False), (7, 20_000, 80_000, 0, 20_000, False)} <= rows
    assert quality(edges).count() == edges.count() and keep_good(edges).schema == edges.schema
    assert quality(empty).collect() == [] and keep_good(empty).collect() == []


def test_host_rates_shrink(spark):
    bad, good = (40, 200, 40, 0, 0), (100, 500, 0, 0, 0)
    rows = [("spam", *bad)] * 90 + [("spam", *good)] * 10 + [("small", *bad)] + [(f"h{i}", *good) for i in range(8) for _ in range(50)]
    df = spark.createDataFrame(rows, "source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.source: r for r in host_verdicts(df, "source").collect()}
    assert got["spam"].rejected and not got["h0"].rejected
    assert 0.8 < got["spam"].rate_short < 0.9 + 1e-9 and got["small"].rate_short < 1  # pulled to the others


def test_hosts_decide(spark):
    """On the given table some hosts are rejected, and some of their documents go that the base rules would keep."""
    for sf in ("sf0.01", "sf0.1"):
        rows = quality(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
        lost = [r for r in rows if not r.base_failed and not r.kept]
        assert lost and all(r.host_rejected for r in lost)
        assert any(r.host_rejected and r.kept for r in rows) and any(not r.host_rejected for r in rows)


def test_bounds_are_optimal():
    rnd = random.Random(1)
    for _ in range(200):
        m, k = rnd.randint(1, 8), rnd.randint(1, 4)
        lengths = np.array(sorted(rnd.sample(range(1, 30), m)))
        counts = np.array([rnd.randint(1, 9) for _ in range(m)])
        cost = lambda bounds, lengths=lengths, counts=counts: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost([*x, lengths[-1]]) for n in range(min(k, m)) for x in itertools.combinations(lengths[:-1], n))
        assert cost(bucket_bounds(lengths, counts, k)) == best


def test_packing(spark, edges, empty):
    counts = token_counts(edges, queries.VOCABULARY)
    packed = pack(counts, max_tokens=512, buckets=3, batch_tokens=2048).collect()
    assert sum(r.n_tokens for r in packed) == sum(r.n_tokens + 1 for r in counts.collect())
    batches = Counter((r.bucket, r.batch) for r in packed)
    bound = {r.bucket: r.padded for r in packed}
    assert all(r.n_tokens <= r.padded <= 512 and r.slot < max(1, 2048 // r.padded) for r in packed)
    for (bucket, batch), n in batches.items():
        assert n == 2048 // bound[bucket] or batch == max(b for k, b in batches if k == bucket)
    assert pack(token_counts(empty, queries.VOCABULARY)).collect() == []


def test_long_white_space_is_counted_exactly(monkeypatch):
    """As the tokenizer counts runs that it can still match itself, and longer ones at all."""
    with open(queries.VOCABULARY, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=table, special_tokens={})
    assert packing.count_tokens(coder, "a" + " \n" * 500_000 + "b") > 500_000
    monkeypatch.setattr(packing, "SPACE_RUN", re.compile(packing.SPACE_RUN.pattern.replace("4096", "3")))
    rnd = random.Random(41)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "word", "7", ".", "é", "'s", " ", "  ", "   ", "\n", "\t", "\xa0", "\u3000", "\x1c", " " * 20, "\n" * 9, " \n\n "]) for _ in range(rnd.randint(0, 12)))
        assert packing.count_tokens(coder, text) == len(coder.encode_ordinary(text)), repr(text)


def test_batches_against_brute_force(spark):
    rnd = random.Random(42)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0, 3, rnd.randint(0, 90), rnd.randint(0, 400)])) for _ in range(300)]
    given = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, n_tokens long, bucket int").repartition(4)
    got = pack(given, max_tokens=128, buckets=4, batch_tokens=512).collect()
    parts = [(i, p, 128 * p, min(128, (n or 0) + 1 - 128 * p)) for i, n in rows for p in range(-(-((n or 0) + 1) // 128))]
    counts = Counter(p[3] for p in parts)
    bounds = bucket_bounds(np.array(sorted(counts)), np.array([counts[n] for n in sorted(counts)]), 4)
    want = []
    for k, bound in enumerate(bounds):
        mine = sorted((p for p in parts if (bounds[k - 1] if k else 0) < p[3] <= bound), key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[3]))
        each = max(1, 512 // bound)
        want += [(*p, k, bound, at // each, at % each) for at, p in enumerate(mine)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hamming_index_finds_all_in_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, (50, 2), dtype=np.uint64)
    asked = np.repeat(items, 20, axis=0)
    for row in asked:
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    got = set(zip(*(x.tolist() for x in HammingIndex(items).search(asked)), strict=True))
    away = np.bitwise_count(asked[:, None] ^ items[None]).sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(away <= RADIUS)), strict=True))


def test_hamming_index_is_bounded():
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 9):
        items = rng.integers(0, 2**63, (n, 2), dtype=np.uint64)
        index = HammingIndex(items)
        assert sum(t.nbytes for t in index.tables) <= n << 17
        assert not index.tables or n >= 8
        assert [x.tolist() for x in index.search(items)] == [list(range(n))] * 2


def test_sorted_index_finds_the_same():
    rng = np.random.default_rng(6)
    items = rng.integers(0, 2**63, (3000, 2), dtype=np.uint64)
    asked = np.repeat(items[::30], 4, axis=0)
    for row in asked:
        for bit in rng.choice(128, rng.integers(0, 50), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = HammingIndex(items)
    assert not index.tables and sum(o.nbytes for o, _ in index.sorted) == 8 * 4 * len(items)
    got = set(zip(*(x.tolist() for x in index.search(asked)), strict=True))
    away = np.bitwise_count(asked[:, None] ^ items[None]).sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(away <= RADIUS)), strict=True))


def test_any_number_of_items_takes_one_pass(spark):
    rnd = random.Random(12)
    items = [(i, " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(10 + i % 3))) for i in range(9000)]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in items[::100]], "doc_id long, text string")
    found = contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i, _ in items[::100]}


def shingle_counts(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def test_recall_against_every_window(spark):
    """Items changed here and there in documents, against the similarity of every window of their length."""
    rnd = random.Random(31)
    items = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([12, 20, 30, 45]))] for _ in range(60)]
    docs = []
    for _ in range(150):
        words = [f"v{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 60))]
        item = list(rnd.choice(items))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            item[rnd.choice([0, 1, 2, len(item) - 2, len(item) - 1, rnd.randrange(len(item))])] = "changed"
        at = rnd.randint(0, len(words))
        docs.append(words[:at] + item + words[at:])
    want = set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            own = shingle_counts(item)
            for at in range(len(words) - len(item) + 1):
                there = shingle_counts(words[at : at + len(item)])
                both = sum((own & there).values())
                if 100 * both >= 80 * (sum(own.values()) + sum(there.values()) - both):
                    want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.99 * len(want)


def test_decontamination_of_megabytes(spark):
    item = " ".join(f"q{k}" for k in range(40))
    long = " ".join(f"w{k % 5000}" for k in range(600_000))
    df = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long)], "doc_id long, text string")
    assert [r.doc_id for r in contaminated(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [1]


def test_decontamination(spark, edges, empty):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 8, 20, 40, 40, 60])] + [(9, None), (10, "")]
    text = lambda n: " ".join(word() for _ in range(n))
    long = items[5][1].split()
    docs = [
        (0, text(200)), (1, f"{text(50)} {items[2][1]} {text(30)}"), (2, f'{text(9)} "{items[3][1].upper()}", {text(9)}'),
        (3, f"{text(20)} {' '.join([*long[:30], 'changed', *long[31:]])} {text(9)}"), (4, items[0][1]), (5, f"x {items[0][1]} y"),
        (6, f"{text(9)} {' '.join(long[:30])} {text(40)}"), (7, None), (None, items[1][1]), (8, f"{items[4][1]} {items[1][1]}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"item_bytes": 300}):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, bench, **options).collect()}
        assert got == {(1, 2), (2, 3), (3, 5), (4, 0), (None, 1), (8, 4), (8, 1)}
    assert sorted(r.doc_id for r in without_benchmark(df, bench).collect()) == [0, 5, 6, 7]
    assert without_benchmark(edges, bench).schema == edges.schema
    assert contaminated(empty, bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_chat_round_trip():
    rnd = random.Random(1)
    bits = ["<", "[", "\\", "s", "I", "/", "R", "é", ">", "\n", " ", "</s>", "[/INST]", "<s>", "<<SYS>>"]
    for _ in range(500):
        conv, rows = 0, []
        for _ in range(rnd.randint(1, 6)):
            conv += rnd.random() < 0.4
            rows.append((conv, rnd.choice(["user", "assistant", "system", "x y]", ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))))
        out = assemble(pa.table({"conv": pa.array([r[0] for r in rows], pa.int64()), "role": [r[1] for r in rows], "text": [r[2] for r in rows]})).to_pylist()
        assert [(x["conv"], *t) for x in out for t in parse(x["formatted"])] == rows
        spans = [(x["conv"], unescape(x["formatted"].encode()[a:b].decode())) for x in out for a, b in zip(x["loss"][::2], x["loss"][1::2], strict=True)]
        assert spans == [(c, t) for c, r, t in rows if r == "assistant"]


def test_chat_batches(spark):
    rows = [(i % 7 if i % 11 else None, i if i % 5 else None, ["user", "assistant", None][i % 3], None if i % 13 == 0 else f"t{i} </s>" * (i % 4)) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, conv long")  # clashing names
    for size in (200, 1 << 20):
        got = {r.conv_id: parse(r.formatted) for r in format_chats(df, batch_bytes=size).collect()}
        want = {}
        for c, t, r, x in sorted(rows, key=lambda q: (str(q[0]), q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
            want.setdefault(c, []).append((r or "", x or ""))
        assert got == want
    assert format_chats(df.limit(0)).collect() == []


def test_language_model(spark, edges, empty):
    rnd = random.Random(2)
    follow = {w: [f"w{rnd.randint(0, 60)}" for _ in range(3)] for w in (f"w{i}" for i in range(61))}
    rows = []
    for i in range(300):
        words = ["w0"]
        while len(words) < 40:
            words.append(rnd.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=8000).collect()
    tokens = {i: [*t.split(), ""] for i, t in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(w for i, t in tokens.items() if i not in held for w in t)
    total, vocabulary = sum(count.values()), len(count)
    for r in got:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, 41, sum(w in count for w in tokens[r.doc_id]), total)
        assert abs(r.base_score - base) < 1e-6
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)  # the next word is one of three
    edge = pitman_yor.score(edges).collect()
    assert len(edge) == edges.count() and all(r.n_tokens >= 1 and r.score < 0 for r in edge)
    assert pitman_yor.score(empty).collect() == []


LAYOUTS = [{}, {"block_bytes": 1 << 16, "shard_bytes": 1 << 15, "book_words": 40}, {"book_words": 0}]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_language_model_against_restaurants_counted_whole(spark, layout):
    """No pair of words occurs twice in training, so each customer has a table and all tables are known."""
    rnd = random.Random(5)
    is_held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    seen, rows = set(), []
    for i in range(4000):
        words = [""]
        while len(words) < 11:
            w = "" if len(words) == 10 else f"{rnd.randint(0, 11999)}qq"
            if is_held(i) or (words[-1], w) not in seen:
                words.append(w)
                seen |= set() if is_held(i) else {(words[-2], w)}
            elif len(words) == 10:  # another word has to be the last
                seen.discard((words[-2], words.pop()))
        rows.append((i, " ".join(words[1:-1])))
    taught = [[*t.split(), ""] for i, t in rows if not is_held(i)]
    count = Counter(w for t in taught for w in t)
    assert len(seen) == sum(count.values()) and max(v for w, v in count.items() if w) * 2000 < len(seen)
    base = (10 + 0.6 * len(count)) / (len(count) + 1)
    follows = lambda c, w: (0.25 * ((c, w) in seen) + (1 + 0.75 * count[c]) * (max(count[w] - 0.6, 0) + base) / (10 + len(seen))) / (1 + count[c])
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **layout).collect()}
    off = []
    for i, t in rows:
        words = ["", *t.split(), ""]
        off.append(got[i] - sum(math.log10(follows(c, w)) for c, w in itertools.pairwise(words)))
    assert max(map(abs, off)) < 0.3 and abs(sum(off)) < 0.02 * len(off)  # the parent's own tables are drawn


@pytest.mark.parametrize("layout", LAYOUTS)
def test_rare_words_have_restaurants_of_their_own(spark, layout):
    """6000 words of one ending, each three times among 39 000 tokens and always before the same word."""
    taught = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10]
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    couples = [f"x{k}qq y{k}" for k in range(6000)]
    texts = {i: couples[j * 6 : j * 6 + 6] for i, j in zip(taught, [*range(1000)] * 3, strict=False)}
    shuffled = random.Random(3).sample(couples, len(couples))
    texts |= {i: shuffled[j * 6 : j * 6 + 6] for j, i in enumerate(out)}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **layout).collect()}
    count = Counter(w for i, t in rows if i in set(taught) for w in [*t.split(), ""])
    total = sum(count.values())
    for i, text in rows:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in [*text.split(), ""])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, 13, 13, total) and abs(r.base_score - base) < 1e-6
    # Three customers at one to three tables and strength 1: a probability from 0.18 to 0.57 for the second
    # word of a couple, whatever came before it; the first words and the end have 1e-6 at least.
    for i in out:
        firsts = 6 * math.log10(3 / total)  # as in the unigram counts
        assert got[i].score > 6 * math.log10(0.18) + firsts - 7 * 1.5, (got[i], firsts)
    assert len(got) == len(rows)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_longer_contexts_against_restaurants_counted_whole(spark, layout):
    """No pair of words occurs twice in training, so each customer of a couple's and of a word's restaurant has a table."""
    rnd = random.Random(6)
    is_held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    seen, rows, taught = set(), [], []
    while len(rows) < 3000:
        words = ["", *(f"{rnd.randint(0, 9999)}qq" for _ in range(9)), ""]
        pairs = {*itertools.pairwise(words)}
        if is_held(len(rows)) and taught:  # the first half of a text that was taught
            words = [*taught[rnd.randrange(len(taught))][:6], *words[6:]]
        elif len(pairs) < 10 or pairs & seen:  # nothing may start or end twice, and no pair come again
            words = None
        else:
            seen |= {p for p in pairs}
            taught.append(words)
        if words:
            rows.append((len(rows), " ".join(words[1:-1])))
    count = Counter(w for t in taught for w in t[1:])
    couples = Counter(x for t in taught for x in itertools.pairwise(["", *t[:-1]]))
    triples = Counter(x for t in taught for x in zip(["", *t], t, t[1:], strict=False))
    assert max(triples.values()) == 1 and couples["", ""] == len(taught)
    base = (10 + 0.6 * len(count)) / (len(count) + 1)
    parent = lambda w: (max(count[w] - 0.6, 0) + base) / (10 + len(seen))
    short = lambda c, w: (0.25 * ((c, w) in seen) + (1 + 0.75 * count[c]) * parent(w)) / (1 + count[c])
    follows = lambda u, c, w: (0.25 * triples[u, c, w] + (1 + 0.75 * couples[u, c]) * short(c, w)) / (1 + couples[u, c])
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in pitman_yor.score(given, order=3, **layout).collect()}
    off = []
    for i, t in rows:
        words = ["", "", *t.split(), ""]
        off.append(got[i] - sum(math.log10(follows(*x)) for x in zip(words, words[1:], words[2:], strict=False)))
    assert max(map(abs, off)) < 0.4 and abs(sum(off)) < 0.02 * len(off)  # the parent's own tables are drawn


def test_the_words_before_the_last_tell_the_next(spark, edges, empty, tmp_path):
    """After `mid` comes what belongs to the word before it: one context word says no more than a coin."""
    rnd = random.Random(4)
    given = {False: [], True: []}
    for i in range(1500):
        ks = [rnd.randrange(8) for _ in range(10)]
        wrong = i % 2 and zlib.crc32(str(i).encode()) % 10 == 0
        given[bool(wrong)].append((i, " ".join(f"a{k} mid z{(k + 1) % 8 if wrong else k}" for k in ks)))
    spark.createDataFrame(given[False] + given[True], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op7_pitman_yor"](spark, str(tmp_path)).collect()}
    right = [got[i].score for i, _ in given[False] if got[i].held_out]
    wrong = [got[i].score for i, _ in given[True]]
    assert len(got) == 1500 and min(right) > max(wrong) + 10  # ten such places a text
    # Per place one of eight is open after the pair and nothing within it.
    assert min(right) > 1.3 * 10 * math.log10(1 / 8) and len(wrong) > 50
    edge = pitman_yor.score(edges, order=3).collect()
    assert len(edge) == edges.count() and all(r.n_tokens >= 1 and r.score < 0 for r in edge)
    assert pitman_yor.score(empty, order=3).collect() == []


def test_shards(spark, edges, empty):
    for df, n in ((edges, 3), (spark.createDataFrame([(i % 50 if i < 900 else 7, "t" * (i % 37)) for i in range(3000)], "doc_id long, text string").repartition(5), 40)):
        rows = balanced_shards(df, n).collect()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        assert len(rows) == df.count() and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
        sizes = [sum(r.size for r in x) for x in by.values()]
        assert n == 3 or (len(by) == n and max(sizes) - min(sizes) <= 2 * max(r.size for r in rows))
        ordered = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)
    crc = Counter((r.doc_id, r.text_crc32, r.size) for r in balanced_shards(edges, 3).collect())
    assert crc == Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in edges.collect())
    assert balanced_shards(empty, 4).collect() == []


def test_chat_parts(spark, tmp_path):
    """A conversation longer than a part is several bounded rows that add up to it."""
    rows = [(i % 3 if i % 4 else None, i, ["user", "assistant", "odd"][i % 3], f"é{i} </s> [\\\\" * (i % 9)) for i in range(400)] + [(1, 500, "assistant", "x" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r.formatted for r in format_chats(df).collect()}
    want = {c: [(r, x) for k, _, r, x in rows if k == c] for c in {r[0] for r in rows}}
    for size in (300, 1 << 20):
        parts = {}
        for r in format_chats(df, batch_bytes=size, part_bytes=1000).collect():
            parts.setdefault(r.conv_id, []).append(r)
        for c, got in parts.items():
            got.sort(key=lambda r: r.part)
            assert {r.parts for r in got} == {len(got)} and max(len(r.formatted) for r in got[:-1]) < 12_000
            assert [r.part for r in got] == list(range(len(got))) and len(got) > 3
            assert "".join(r.formatted for r in got) == whole[c]
            assert [t for r in got for t in parse(r.formatted, r.part)] == want[c]
            assert all(sum(len(x.encode()) for _, x in parse(r.formatted, r.part)[:-1]) <= 1000 for r in got)  # a part and one turn
            spans = [unescape(r.formatted.encode()[a:b].decode()) for r in got for a, b in zip(r.loss[::2], r.loss[1::2], strict=True)]
            assert spans == [x for r, x in want[c] if r == "assistant"]
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    told = {r.conv_id: r for r in queries.QUERIES["op6_chat_format"](spark, str(tmp_path)).collect()}
    small = lambda *a, **k: format_chats(*a, **k, part_bytes=1000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "format_chats", small)
        assert {r.conv_id: r for r in queries.QUERIES["op6_chat_format"](spark, str(tmp_path)).collect()} == told


def test_chat_long_texts(monkeypatch):
    """Escaping and gathering go step by step, wherever a step ends."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("<[\\/sé ") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    table = pa.table({"conv": pa.array([0] * 60, pa.int64()), "role": ["user"] * 60, "text": texts})
    whole = assemble(table)
    for step in (1, 2, 7, 100):
        monkeypatch.setattr(chat, "STEP", step)
        assert assemble(table) == whole


def edit_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton():
    rnd = random.Random(2)
    terms = ["abcab", "aabbcc", "bca", "abcabc", "cabbage"]
    automaton = LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rnd.choice("abcgex") for _ in range(rnd.randint(1, 8)))
        got = int(automaton.match(_codes(word), np.array([0]), np.array([len(word)]))[0])
        assert got == (1 if word in terms else 2 if any(len(t) >= 5 and edit_distance(word, t) == 1 for t in terms) else 0)


def test_context_features():
    reader = Reader(["idiot"], ["said"])
    texts = ["You Idiot!", 'he said "idiot" twice', "an idoit", None, "", "idiotic idiots", 'open " idiot']
    assert reader.features(texts).tolist() == [[1, 0, 0, 0], [1, 0, 1, 1], [0, 1, 0, 0], [0] * 4, [0] * 4, [0, 1, 0, 0], [1, 0, 0, 0]]


def brute_features(text, terms, reporting):
    """Word by word and line by line."""
    out, before = [0, 0, 0, 0], []
    for k, line in enumerate((text or "").lower().split("\n")):
        for m in re.finditer(r"[^\W_]+", line):
            for word, at in _brute_words(m):
                fuzzy = any(len(t) >= 5 and edit_distance(word, t) == 1 for t in terms)
                if word in terms or fuzzy:
                    quotes = lambda part: sum(part.count(c) for c in '"“”«»')
                    out[0 if word in terms else 1] += 1
                    out[2] += quotes(line[:at]) % 2 == 1 and quotes(line[at + len(word) :]) > 0
                    out[3] += any(w in reporting for w in before[-4:])
                before.append(word)
    return out


def _brute_words(m):
    for part in re.finditer("[぀-ヿ㐀-䶿一-鿿𠀀-\U0003ffff]+|[^぀-ヿ㐀-䶿一-鿿𠀀-\U0003ffff]+", m.group()):
        word, at = part.group(), m.start() + part.start()
        if len(word) > 1 and re.match("[぀-ヿ㐀-䶿一-鿿𠀀-\U0003ffff]", word):
            yield from ((word[i : i + 2], at + i) for i in range(len(word) - 1))
        else:
            yield word, at


def test_features_against_brute_force():
    rnd = random.Random(21)
    terms, reporting = ["idiot", "笨蛋", "дурак", "trottel", "바보", "qz"], ["said", "说了"]
    bits = ["idiot", "idoit", "Idiots", "trotel", "trottel", "дурак", "дурок", "笨蛋", "他说了笨蛋吗", "바보", "said", '"', "“", "»", "\n", " ", ", ", "x", "qz", "_", "你", "３idiot", "İ", "𠀀𠀁"]
    texts = [None, ""] + ["".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    got = Reader(terms, reporting).features(texts)
    assert got.tolist() == [brute_features(t, terms, reporting) for t in texts]
    assert got[:, 0].sum() > 100 and got[:, 1].sum() > 50 and got[:, 2].sum() > 20 and got[:, 3].sum() > 20


def test_words_are_found_alike():
    rnd = random.Random(22)
    reader = Reader(["x"])
    for _ in range(300):
        text = "".join(rnd.choice("aÉß1_ .\n你好あア𠀀바é") for _ in range(rnd.randint(0, 30))).lower()
        starts, ends = reader.spans(_codes(text)) if text else ([], [])
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == words_of(text)


def test_long_lines_take_linear_time():
    line = 'he said "you idiot" and more of it, ' * 280_000  # 10 MB without a line end
    start = time.perf_counter()
    assert Reader(["idiot"], ["said"]).features([line]).tolist() == [[280_000, 0, 280_000, 280_000]]
    assert time.perf_counter() - start < 60


def test_any_script_is_learned(spark):
    """A term, and the words that tell of quoted speech, in a script without blanks."""
    rnd = random.Random(23)
    rows = [(i, "".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(30)) + ("笨蛋" if i % 4 == 0 else "") + "".join(rnd.choice("辰宿列张") for _ in range(5))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity(df, labels).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out)
    talk = [(f"w{rnd.randint(0, 99)} " * 9 + ("narrator told of idiot" if i % 2 else "you are idiot"), 1 - i % 2) for i in range(200)]
    found = mine_reporting(spark.createDataFrame(talk, "text string, toxic int"), ["idiot"])
    assert {"narrator", "told", "of"} <= set(found) and "are" not in found


def test_toxicity(spark, edges, empty):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(60)]
        toxic = int(i % 6 == 0)
        if toxic:
            words[rnd.randrange(60)] = rnd.choice(["grobble", "snarfed", "grobbel"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(5000 + i, "copied text with rareword in it") for i in range(60)]
    labels += [(5000 + i, 1) for i in range(60)] + [(None, 1), (3, None)]
    df, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(df, given).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert toxicity(edges, given).count() == edges.count()
    assert toxicity(empty, given).collect() == [] and toxicity(df, given.limit(0)).count() == len(rows)


def test_lexicon_holds_every_term(spark):
    copied = " ".join(f"copy{i}" for i in range(2100))
    rows = [(copied, 1)] * 12 + [(f"w{i} grobble v{i} snarfed", 1) for i in range(8)] + [(f"w{i} v{i}", 0) for i in range(8)]
    assert sorted(mine_lexicon(spark.createDataFrame(rows, "text string, toxic int"))) == ["grobble", "snarfed"]


def test_automaton_forgets():
    terms = ["abcab", "aabbcc", "bca", "abcabc", "cabbage"]
    whole, small = LexiconAutomaton(terms), LexiconAutomaton(terms, keep=0)
    for word in ("abcab", "cabage", "acbab", "bca", "bcaa", "xabcab", ""):
        args = _codes(word), np.array([0]), np.array([len(word)])
        assert small.match(*args) == whole.match(*args)


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    lines = corpus_pipeline.line_dedup(spark, good, SF)
    assert good.columns == lines.columns == docs.columns and lines.schema == docs.schema
    one = corpus_pipeline.near_dedup(spark, lines, SF)
    clean = corpus_pipeline.decontamination(spark, one, SF)
    assert {r.doc_id for r in out} == {r.doc_id for r in clean.collect()} and clean.columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, clashing names, empty tables."""
    rnd = random.Random(51)
    body = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    clean, item, shared = [body(120) for _ in range(8)], body(30), "this very line is held by several of the documents"
    rows = [(k, t, "en", "src0" if k % 2 else None, len(t)) for k, t in enumerate(clean)]
    rows += [(20, clean[0], "en", "src0", 0), (21, clean[1] + " one two", None, None, None), (22, f"{body(60)} {item} {body(9)}", "en", "src1", 1)]
    rows += [(30 + k, f"{body(80)}\n{shared}\n{body(9)}", "en", "src1", 1) for k in range(4)]
    rows += [(3, clean[3], "en", "src0", 0), (None, body(90), None, None, None), (40, None, "en", None, 0), (41, "", "en", "src1", 0), (42, " \n\t", "en", "src1", 3), (43, body(60_000), "en", "src1", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, 7, "x", 5) for r in rows], schema + ", shard int, component_id string, part long").repartition(3)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    for name, table in (("documents", df), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/full/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.schema == docs.schema and sum(shared in (r.text or "") for r in lines.collect()) == 1
    assert corpus_pipeline.line_dedup(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    # Copies and near copies go (20, 21), the benchmark passage (22), texts without 50 words; a repeated row stays as often.
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter([*range(8), 3, *range(30, 34), None, 43])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_shards_against_brute_force(spark):
    rnd = random.Random(52)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "", "é" * rnd.randint(0, 90), "x" * rnd.randint(0, 400)])) for _ in range(700)]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 9).collect()
    told = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    whole, at, slots, want = sum(r[2] for r in told), 0, Counter(), []
    for i, crc, size in told:
        shard = min(8, (2 * at + size) * 9 // (2 * whole))  # where the middle of the row falls
        want.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += size
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}" * (k % 5), "x") for k in range(200)], "doc_id long, text string, slot string").repartition(4)
    assigned = balanced_shards(df, 6)
    write_shards(df, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text, r["__shard"]) for r in back.collect()) == Counter((r.doc_id, f"text {r.doc_id}" * (r.doc_id % 5), r.shard) for r in assigned.collect())
