"""Line, suffix and near-duplicate removal against brute force."""

import random
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from cfgveil.llm import near_dup
from cfgveil.llm.components import components
from cfgveil.llm.line_dedup import PerfectHash, dedup_lines
from cfgveil.llm.near_dup import _meeting, _rare_buckets, near_duplicates, parities, superminhash, without_near_duplicates
from cfgveil.llm.suffix_dedup import remove_repeats, separated, sort_suffixes

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    smallest = lambda i: -(1 << 63) if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(smallest(i))
    lost = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if lost.get(key(x), smallest(i)) == smallest(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def brute_bytes(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - length + 1):
            if body[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(body[s : s + length])
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(body), sum(gone), spans, bytes(c for c, g in zip(body, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def brute_near(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = set(zip(*[words[j:] for j in range(size)], strict=False)) if len(words) >= size else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def family(seed, members, edits):
    """Edited copies of one text: some linked only through others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    out = []
    for _ in range(members):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 99999)}"
        out.append(" ".join(words))
    return out


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = PerfectHash(keys[:, 0], keys[:, 1])
    assert sorted(table.index(keys[:, 0], keys[:, 1]).tolist()) == list(range(5000))


def test_lines_edges(edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = dedup_lines(edges, stats=True, block_bytes=50_000).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    replaced = dedup_lines(edges)
    assert replaced.schema == edges.schema and replaced.count() == edges.count()
    assert dedup_lines(empty).collect() == [] and dedup_lines(empty, stats=True).columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]


def test_lines_hot(spark):
    rows = [(i, f"own line of the document number {i}\nthe same long line in every document\nshort") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, dedup_lines(df, stats=True, block_bytes=3000).collect()), key=repr)
    assert got == brute_lines(rows)


def test_transform_finds_common_prefixes():
    rnd = random.Random(5)
    for _ in range(200):
        length = rnd.choice([2, 3, 5, 9])
        body = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(2, 200))) + b"\xfe"
        text = np.frombuffer(body, np.uint8)
        order = sort_suffixes(text, length)
        cut = separated(text, order, length)
        for j, (a, b) in enumerate(pairwise(order.tolist()), 1):
            x, y = body[a : a + length], body[b : b + length]
            assert cut[j] == (x != y or len(x) < length or len(y) < length)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000}, {"block_bytes": 20_000, "hot_regions": 2}, {"block_bytes": 30_000, "text_bytes": 2000}])
def test_bytes_against_brute_force(spark, options):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(20, 300))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefg ") for _ in range(40)) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    rows += [(900, "x" * 3000), (901, "xy" * 700), (902, None), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, **options).collect()), key=repr)
    assert got == brute_bytes(rows, 100)


def test_bytes_edges(edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(edges).collect()), key=repr)
    assert got == brute_bytes(rows, 100)
    assert remove_repeats(empty).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 60, 900):
        seen = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            shared = n * 8 // 9
            both = np.r_[a, a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)]
            s = superminhash(both, np.repeat([0, 1], n), 2)
            seen.append((s[0] == s[1]).mean())
        assert abs(np.mean(seen) - shared / (2 * n - shared)) < 0.03


def test_parity_bounds_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2000, n).astype(np.uint64)) for n in (0, 1, 40, 300, 1500)]
    words = parities(sets)
    for x, p in zip(sets, words, strict=True):
        for y, q in zip(sets, words, strict=True):
            assert sum(int(w).bit_count() for w in p ^ q) <= len(np.setxor1d(x, y))
    assert not words[0].any() and parities([]).shape == (0, words.shape[1])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


@pytest.mark.parametrize("percent", [80, 70])
def test_near_against_brute_force(spark, percent):
    texts = [t for seed, (members, edits) in enumerate([(30, 4), (40, 9), (5, 1), (25, 14)]) for t in family(seed, members, edits)]
    texts += ["", None, "one two", "One TWO", "one", *["the same text in many copies of one document"] * 20]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if percent == 80:
        assert sorted(map(tuple, near_duplicates(df, shingle=4).collect())) == brute_near(rows, 4, 80)
    else:  # below the design similarity bands may miss a pair: nothing is linked wrongly
        exact = {i: c for i, _, c, _ in brute_near(rows, 4, 70)}
        assert all(exact[r.component_id] == exact[r.doc_id] for r in near_duplicates(df, shingle=4, percent=70).collect())


def _keys(spark, sets, percent=80):
    df = spark.createDataFrame([(k, k, sorted(x)) for k, x in enumerate(sets)], "node long, set_a long, body array<long>").repartition(3)
    keys = defaultdict(set)
    for r in _rare_buckets(df, percent).collect():
        keys[r.node].add(r.key)
    return keys


def test_rare_buckets_hold_every_link(spark):
    rnd = random.Random(9)
    sets = [{rnd.randint(0, 40) for _ in range(rnd.randint(1, 12))} for _ in range(150)]
    for _ in range(40):
        base = rnd.choice(sets)
        sets.append((base - set(rnd.sample(sorted(base), 1 if len(base) > 2 else 0))) | {rnd.randint(0, 60)})
    for percent in (80, 65):
        keys = _keys(spark, sets, percent)
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert len(linked) > 8 and all(keys[a] & keys[b] for a, b in linked)


def _met(spark, sets, percent=80):
    """Times that each pair passes the bound of its places in the buckets of rare shingles."""
    df = spark.createDataFrame([(i, 0, sorted(s)) for i, s in enumerate(sets)], "node long, set_a long, body array<long>")
    buckets, met = defaultdict(list), Counter()
    for r in _meeting(_rare_buckets(df, percent), percent).collect():
        buckets[r.key].append((r.node, r.n, r.most))
    for rows in buckets.values():
        met.update((a, b) for a, n, s in rows for b, n2, s2 in rows if a > b and 100 * min(s, s2) >= percent * (n + n2 - min(s, s2)))
    return met


def test_places_bound_what_sets_share(spark):
    rnd = random.Random(4)
    sets = [{rnd.randint(0, 60) for _ in range(rnd.randint(1, 30))} for _ in range(60)]
    for _ in range(90):
        base = rnd.choice(sets)
        sets.append((base - set(rnd.sample(sorted(base), len(base) // 10))) | {rnd.randint(0, 90) for _ in range(rnd.randint(0, 2))})
    for percent in (80, 65):
        met = _met(spark, sets, percent)
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert len(linked) > 50 and all(met[pair] for pair in linked)
    # Members of a family share too little for a link; each has 13 shingles in common with either neighbour first.
    family = [set(range(200)) - set(rnd.sample(range(200), 26)) | {1000 + 13 * i + k for k in range(13)} | {1000 + 13 * ((i + 1) % 60) + k for k in range(13)} for i in range(60)]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(family) for b in family[:i])
    assert {(a - b) % 60 for a, b in _met(spark, family)} <= {1, 59}


def test_families_of_unlinked_texts_stay_cheap(spark):
    """Twice the members of a family of alike but unlinked texts have about twice the meetings, not four times."""
    def meetings(n):
        rnd = random.Random(10)
        base = list(range(400))
        sets = [{x if rnd.random() > 0.25 else rnd.randint(10**6, 10**9) for x in base} for _ in range(n)]
        sizes = Counter(k for ks in _keys(spark, sets).values() for k in ks)
        return sum(m * m for m in sizes.values() if m > 1) + n

    assert meetings(400) < 3 * meetings(200)


def test_buckets_met_in_full_are_not_dealt_anew(spark, monkeypatch):
    """Alike texts that stay unlinked (120 of 160 shingles) have all met in their small buckets; links among those that were no center are found there."""
    dealt = []
    monkeypatch.setattr(near_dup, "_rare_buckets", lambda sets, percent, f=near_dup._rare_buckets: (dealt.append(sets.count()), f(sets, percent))[1])
    rows, links = [], {}
    for k in range(12):
        common = " ".join(f"w{k}x{i}" for i in range(123))
        ends = [" ".join(f"e{k}x{m}x{i}" for i in range(20)) for m in range(4)]
        near = ends[3].rsplit(" ", 1)[0] + " other"
        rows += [(10 * k + m, f"{common} {end}") for m, end in enumerate([*ends, near][: 2 + k % 4])]
        links |= {10 * k + 4: 10 * k + 3} if k % 4 == 3 else {}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_duplicates(df, shingle=4).collect()} == {i: links.get(i, i) for i, _ in rows}
    assert dealt == [0]


def test_near_repeated_ids(spark):
    """Rows that share an id are one node, whichever of their texts also occur under smaller ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (20, c), (20, d), (21, d), (22, c + " more"), (30, "alone it is and stays"), (31, a), (31, None), (32, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, shingle=4).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (20, 20, True), (21, 20, False), (22, 20, False), (30, 30, True), (31, 3, False), (32, 32, True)}
    assert sorted(r.doc_id for r in without_near_duplicates(df, shingle=4).collect()) == [3, 20, 20, 30, 32]


def test_near_edges(edges, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(edges, shingle=4).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(None, 5)] == (None, True)
    assert got[(11, 1)] == (10, False) and got[(10, 1)] == (10, True) and got[(5, 5)] == (4, False)  # 5 of 6 shingles
    kept = without_near_duplicates(edges, shingle=4)
    assert kept.schema == edges.schema and 11 not in {r.doc_id for r in kept.collect()}
    assert near_duplicates(empty).collect() == []
