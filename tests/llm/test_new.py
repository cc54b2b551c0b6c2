"""Sentencepiece coding, whitening and the conversation trie, against the library, numpy and brute force."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from cfgveil.llm import piece_bpe, queries
from cfgveil.llm.blocks import utf8
from cfgveil.llm.piece_bpe import decode_ids, decode_pieces, encode_pieces, encode_texts, read_vocabulary
from cfgveil.llm.prefix_trie import WIDTH, Node, RadixTree, prefix_trie
from cfgveil.llm.whitening import jacobi, pivoted_cholesky, whiten

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return read_vocabulary(queries.PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def coded(vocab, texts):
    ids, at = encode_texts(vocab, *utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(at)], decode_ids(vocab, ids, at).to_pylist()


def test_pieces_as_the_library(vocab, library):
    rnd = random.Random(1)
    texts = ["", None, " ", "   ", " a", "▁▁ a▁", "\n\n", "<s> </s><unk><0x41>", "日本語 梦", "😀 é ⁇", "\x00\x01", "x" * 30_000, " " * 9001, "é" * 300, "aaaa" * 500, "ababab" * 300]
    kinds = ["ab", "abc ", "etaoin ", "▁ a", "aé ü\n", "abcdefghijklmnopqrstuvwxyz", " ", " \t\n.,;:!?-", "ACGT", "The and ing er on in", "😀日本ñ <>0123"]
    texts += ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    for kind in kinds:
        texts += ["".join(rnd.choice(kind) for _ in range(rnd.choice([5, 20, 300, 2000]))) for _ in range(60)]
    ids, decoded = coded(vocab, texts)
    want = [library.encode(t or "", add_eos=True) for t in texts]
    assert ids == want and decoded == [library.decode(w) for w in want]


def test_long_words_as_the_library(vocab, library, monkeypatch):
    """Words without an end merge as short ones do, in time that grows with their length."""
    monkeypatch.setattr(piece_bpe, "LONG_WORD", 2)
    rnd = random.Random(3)
    kinds = ["ab", "abc ", "etaoin ", "aé", "abcdefghijklmnopqrstuvwxyz", " ", "ACGT", "Theandingerosin", "😀日本ñ", "x"]
    texts = ["".join(rnd.choice(kind) for _ in range(rnd.choice([3, 9, 80, 900]))) for kind in kinds for _ in range(25)]
    assert coded(vocab, texts)[0] == [library.encode(t, add_eos=True) for t in texts]
    monkeypatch.undo()
    long = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))
    start = time.perf_counter()
    assert coded(vocab, [long])[0] == [library.encode(long, add_eos=True)]
    assert time.perf_counter() - start < 30


def test_any_ids_decode_as_in_the_library(vocab, library):
    rnd = random.Random(2)
    lists = [[rnd.randint(0, rnd.choice([5, 258, 31_999])) for _ in range(rnd.randint(0, 20))] for _ in range(2000)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = [t for k in range(0, 2000, 4) for t in decode_ids(vocab, np.array(sum(lists[k : k + 4], []), np.int32), at[k : k + 5] - at[k]).to_pylist()]
    assert got == [library.decode(x) for x in lists]


def test_pieces_over_tables(spark, edges, empty, library):
    rows = decode_pieces(encode_pieces(edges, queries.PIECE_MODEL), queries.PIECE_MODEL).collect()
    assert len(rows) == edges.count() and set(edges.columns) < set(rows[0].asDict())
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
    bare = encode_pieces(edges, queries.PIECE_MODEL, out="shard", end=False)  # a clashing name is replaced
    assert {c for c, _ in bare.dtypes} == set(edges.columns) and bare.where("text = ''").first().shard == []
    assert encode_pieces(empty, queries.PIECE_MODEL).collect() == []
    lists = spark.createDataFrame([(None,), ([],), ([None, 2],)], "ids array<int>")
    assert [r.decoded for r in decode_pieces(lists, queries.PIECE_MODEL).collect()] == ["", "", ""]


def test_piece_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def brute_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    y = x - np.array([s / n for s in sums])
    values, columns = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, values[::-1], columns[:, ::-1], y


def test_whitening_query(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, values, columns, y = brute_whitening([r.embedding for r in given])
    want = {r.vec_id: (d, row @ columns[:, :32] / np.sqrt(values[:32])) for r, d, row in zip(given, deviation, y, strict=True)}
    rows = queries.op12_whitening(spark, SF).collect()
    assert len(rows) == 32 * len(given) and {r.n for r in rows} == {n}
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r.whitened
        assert r.deviation == want[r.vec_id][0] and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
    mine = np.array([[got[r.vec_id][k] for k in range(1, 33)] for r in given])
    theirs = np.array([want[r.vec_id][1] for r in given])
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.allclose(mine * signs, theirs, atol=1e-7)


def test_whitening_edges(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.random(), rnd.random(), 0.5, None if i == 3 else rnd.random()], "x") for i in range(40)]
    rows += [(None, [1.0, 2.0, 0.5, 3.0], "x"), (7, None, "x"), (8, [], "x"), (9, [float("nan")] * 4, "x"), (10, [float("inf"), 0.0, 0.0, 0.0], "x"), (11, [1.0], "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(3)
    got = whiten(df).collect()
    assert {r.n for r in got} == {41} and len(got) == 41 * 3  # the constant dimension adds no component
    assert sum(r.vec_id == 5 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3
    again = {(r.vec_id, r.component): r.whitened for r in whiten(df.repartition(1)).collect()}
    assert all(math.isclose(r.whitened, again[r.vec_id, r.component], abs_tol=1e-9) for r in got)
    assert whiten(df.limit(0)).collect() == [] and whiten(df.where("vec_id = 5")).collect() == []
    huge = spark.createDataFrame([(k, [1e15 * k, float(k * k)]) for k in range(5)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whiten(huge).collect()} == {0: None, 1: None, 2: 409_600, 3: None, 4: None}  # vector 2 is near the mean


def test_factor_and_rotation():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (2, 2), (7, 3), (33, 33), (64, 10)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        factor = pivoted_cholesky(a @ a.T)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a @ a.T)
        norms, columns = jacobi(factor)
        assert np.allclose(norms**2, np.linalg.eigvalsh(a @ a.T)[::-1][:rank], rtol=1e-8, atol=1e-14)
        assert np.allclose(columns.T @ columns, np.eye(rank)) and (np.diff(norms) <= 0).all()
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) and jacobi(np.zeros((3, 0)))[0].shape == (0,)


def test_node_layouts_grow():
    node, kids = Node(0, 0, 0), {}
    letters = list(range(256))
    random.Random(5).shuffle(letters)
    for k, byte in enumerate(letters, 1):
        kids[byte] = Node(byte, 0, 1)
        node.put(byte, kids[byte])
        assert node.layout == (4 if k <= 4 else 16 if k <= 16 else 48 if k <= 48 else 256)
        assert all(node.child(b) is kids.get(b) for b in range(256))
        assert [x.of for x in node.children()] == sorted(kids)
    other = Node(-1, 0, 1)
    node.put(7, other)
    assert node.child(7) is other


def test_radix_tree_holds_its_keys():
    rnd = random.Random(6)
    for _ in range(200):
        keys = list({bytes(rnd.choice([0, 1, 255]) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 40))})
        tree, found = RadixTree(keys), {}
        open_ = [(tree.root, b"")]
        while open_:
            node, path = open_.pop()
            path += keys[node.of][node.start : node.stop]
            if node.end >= 0:
                found[node.end] = path
            assert node is tree.root or node.end >= 0 or len(node.children()) > 1  # paths are compressed
            open_ += [(kid, path) for kid in node.children()]
        assert found == dict(enumerate(keys))


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []
    for path, convs in members.items():
        under, leaves, saved = [path], 0, 0
        while under:
            p = under.pop()
            under += kids[p]
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(c for c in convs if paths[c] == path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_against_brute_force(spark):
    for seed, bytes_ in ((7, 1), (8, 2000), (9, 16 << 20)):  # ranges of a few sequences up to all of them
        rnd = random.Random(seed)
        opening = [("system", f"be {k}") for k in range(2)]
        rows = []
        for c in [*range(-25, 160), 10**12]:
            turns = [rnd.choice(opening)] * rnd.randint(0, 1) + [(rnd.choice(["user", None]), rnd.choice(["a b", "a", "", None, "c\td e"])) for _ in range(rnd.choice([1, 2, 3, 5]))]
            rows += [(c, k if rnd.random() < 0.9 else None, *t) for k, t in enumerate(turns)]
        rows += [(3, 0, "user", "tie"), (3, 0, "user", "another"), (3, 0, "user", "tie"), (None, 0, "user", "x")]
        rows += [(c, k, "user", f"same {k}") for c in range(200, 260) for k in range(3)]  # copies
        rows += [(c, k, "user", f"w{k}") for c in (300, 301, 302) for k in range(400 + c)]  # long, one the start of another
        rnd.shuffle(rows)
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
        got = [tuple(r) for r in prefix_trie(df, range_bytes=bytes_).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
        assert sorted(got, key=repr) == brute_trie(rows)


def test_trie_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(none).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).collect() == []
    one = prefix_trie(spark.createDataFrame([(20, None, None, "x " * 1_000_000)], none.schema)).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in one) == [(0, 1, 1, 0), (1, 1, 1, 0)]
    assert WIDTH == 16
