"""Encode and decode texts with a byte-pair sentencepiece model, by vectorised merge rounds.

A batch's distinct words are one flat array of symbols. In every round each word finds its
best pair (a segmented minimum of the pair ranks), merges that pair's occurrences at once,
from the left, and the array is compacted; words without a pair leave it.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cfgveil.llm.blocks import pieces, utf8

SPACE = 0x2581  # what the model writes for a blank
NONE = np.int32(2**31 - 1)  # the rank of a pair that is no piece
BATCH_BYTES = 4 << 20
LONG_WORD = 4096  # symbols from which a word is merged by itself


@dataclass
class Vocabulary:
    """The tables that encoding and decoding look things up in; their size is the model's.

    Symbols are piece ids, then (from `size`) characters that occur in pieces but are none.
    """

    size: int
    symbol_of: np.ndarray  # code point -> symbol, -1 for none
    alone: np.ndarray  # code point -> whether no piece holds it beside another
    cut_at_space: bool  # whether no piece holds a blank behind another character
    pairs: np.ndarray  # left * symbols + right, ascending
    merged: np.ndarray  # the piece that a pair makes
    rank: np.ndarray  # symbol -> its place by falling score; equal scores share one
    symbols: int
    extra: np.ndarray  # code points of the symbols from `size`
    byte_ids: np.ndarray
    end: int
    body: np.ndarray  # bytes that the ids stand for, one after another
    body_at: np.ndarray
    control: np.ndarray
    byte: np.ndarray
    spaced: np.ndarray  # ids of pieces that begin with a blank


def read_vocabulary(path: str) -> Vocabulary:
    """The tables of a model file, read on the driver.

    The model must be a BPE with byte fallback that changes nothing in a text but its blanks
    and puts one before it; a ValueError tells of any other.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind = proto.ModelProto.SentencePiece
    norm = model.normalizer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain:
        raise ValueError("only BPE models with byte fallback and no text normalization")
    types = [p.type for p in model.pieces]
    if kind.USER_DEFINED in types or kind.UNUSED in types:
        raise ValueError("models with user-defined or unused pieces aren't supported")
    names = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    chars = sorted({c for name in names for c in name})
    symbol = dict(names)
    extra = [c for c in chars if c not in symbol]
    symbol |= {c: len(types) + k for k, c in enumerate(extra)}
    symbols = len(types) + len(extra)

    scores = np.array([p.score for p in model.pieces], np.float32)
    rank = np.full(symbols, NONE, np.int32)
    rank[: len(types)] = np.unique(-scores, return_inverse=True)[1]
    pairs = [
        (symbol[name[:k]] * symbols + symbol[name[k:]], i)
        for name, i in names.items() for k in range(1, len(name)) if name[:k] in symbol and name[k:] in symbol
    ]
    pairs.sort()

    symbol_of, alone = np.full(0x110000, -1, np.int32), np.ones(0x110000, bool)
    for c in chars:
        symbol_of[ord(c)] = symbol[c]
    alone[[ord(c) for c in {c for name in names if len(name) > 1 for c in name}]] = False
    blank = chr(SPACE)
    bodies = [_body(p.piece, p.type, kind) for p in model.pieces]
    return Vocabulary(
        size=len(types), symbol_of=symbol_of, alone=alone, cut_at_space=not any(a != blank and b == blank for name in names for a, b in zip(name, name[1:])),
        pairs=np.array([k for k, _ in pairs], np.int64), merged=np.array([i for _, i in pairs], np.int32), rank=rank, symbols=symbols,
        extra=np.array([ord(c) for c in extra], np.uint32),
        byte_ids=np.array([next(i for i, p in enumerate(model.pieces) if p.type == kind.BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)], np.int32),
        end=model.trainer_spec.eos_id, body=np.frombuffer(b"".join(bodies), np.uint8), body_at=np.concatenate([[0], np.cumsum([len(b) for b in bodies])]),
        control=np.array([t == kind.CONTROL for t in types]), byte=np.array([t == kind.BYTE for t in types]), spaced=np.array([p.type == kind.NORMAL and p.piece.startswith(blank) for p in model.pieces]),
    )


def _body(piece: str, type_: int, kind) -> bytes:
    if type_ == kind.CONTROL:
        return b""
    if type_ == kind.UNKNOWN:
        return " ⁇ ".encode()  # what the library shows for an unknown id
    return bytes([int(piece[3:5], 16)]) if type_ == kind.BYTE else piece.replace(chr(SPACE), " ").encode()


def lookup(vocab: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, rank) of neighbouring symbols; rank NONE where they make no piece."""
    key = left.astype(np.int64) * vocab.symbols + right
    at = np.minimum(np.searchsorted(vocab.pairs, key), len(vocab.pairs) - 1)
    found = (vocab.pairs[at] == key) & (left >= 0) & (right >= 0)
    piece = np.where(found, vocab.merged[at], -1)
    return piece, np.where(found, vocab.rank[piece], NONE)


def merge_words(vocab: Vocabulary, symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of every word until no pair makes a piece; (symbols, offsets).

    The library merges the best pair of a word, the leftmost of equals, one at a time. Here
    all occurrences of a word's best rank that don't overlap, counted from the left, merge in
    one round, up to the first whose result makes a pair of that rank or a better one with a
    neighbour: that pair might come first, so the rest waits. The result is thus the same.
    """
    n_words = len(offsets) - 1
    word = np.repeat(np.arange(n_words), np.diff(offsets))
    symbol = symbol.astype(np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.flatnonzero(np.diff(offsets) > LONG_WORD).tolist():
        alone = merge_long(vocab, symbol[offsets[w] : offsets[w + 1]])
        done.append((np.full(len(alone), w), alone))
    short = np.repeat(np.diff(offsets) <= LONG_WORD, np.diff(offsets))
    word, symbol = word[short], symbol[short]
    piece, rank = np.full(len(symbol), -1, np.int32), np.full(len(symbol), NONE, np.int32)
    renew = np.flatnonzero(word[1:] == word[:-1])
    while len(symbol):
        piece[renew], rank[renew] = lookup(vocab, symbol[renew], symbol[renew + 1])
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        over = np.repeat(best == NONE, np.diff(np.append(starts, len(symbol))))
        if over.any():  # words without a pair leave
            done.append((word[over], symbol[over]))
            word, symbol, piece, rank = word[~over], symbol[~over], piece[~over], rank[~over]
            if not len(symbol):
                break
            starts, best = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), best[best != NONE]
        best = np.repeat(best, np.diff(np.append(starts, len(symbol))))
        # Every other place of a run of neighbouring candidates, from its left end.
        at = np.flatnonzero(rank == best)
        first = np.concatenate([[True], np.diff(at) != 1])
        order = np.arange(len(at))
        at = at[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
        # A merge whose result pairs as well with what stands beside it then holds the rest back.
        chosen = np.zeros(len(symbol), bool)
        chosen[at] = True
        made = piece[at]
        before, behind = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        twice = np.maximum(at - 2, 0)
        left = np.where(chosen[twice] & (at >= 2), piece[twice], symbol[before])
        rank_left = np.where((at >= 1) & (word[before] == word[at]), lookup(vocab, left, made)[1], NONE)
        rank_right = np.where((at + 2 < len(symbol)) & (word[behind] == word[at]), lookup(vocab, made, symbol[behind])[1], NONE)
        held = np.cumsum(np.minimum(rank_left, rank_right) <= rank[at])
        held = np.concatenate([[0], held[:-1]])  # before this place, over all words
        new_word = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        kept = held == np.maximum.accumulate(np.where(new_word, held, 0))
        at, made = at[kept], made[kept]
        symbol[at] = made
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        place = np.cumsum(stays) - 1
        word, symbol, piece, rank = word[stays], symbol[stays], piece[stays], rank[stays]
        at = place[at]
        touched = np.zeros(len(symbol) + 1, bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        touched[len(symbol) - 1 :] = False
        touched[:-2] &= word[1:] == word[:-1]
        rank[at] = NONE  # the last symbol of a word has no pair
        renew = np.flatnonzero(touched)
    if not done:
        return symbol, offsets
    word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(word, kind="stable")
    return symbol[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])


def merge_long(vocab: Vocabulary, symbol: np.ndarray) -> np.ndarray:
    """The merges of one long word: as in `merge_words`, but a round looks at the places of its
    rank alone, which wait under it, and not at the whole word. Symbols are linked, not moved.
    """
    n = len(symbol)
    symbol, alive = symbol.copy(), np.ones(n, bool)
    behind, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
    piece, rank = np.full(n, -1, np.int32), np.full(n, NONE, np.int32)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        at = at[np.argsort(rank[at], kind="stable")]
        for group in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
            r = int(rank[group[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(group)

    piece[:-1], rank[:-1] = lookup(vocab, symbol[:-1], symbol[1:])
    wait(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        first = np.concatenate([[True], behind[at[:-1]] != at[1:]])
        order = np.arange(len(at))
        chosen = (order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0
        rest, at = at[~chosen], at[chosen]
        made, second = piece[at], behind[at]
        left, right = before[at], behind[second]
        merged_before = np.concatenate([[False], left[1:] == second[:-1]])
        beside = np.where(merged_before, np.concatenate([made[:1], made[:-1]]), symbol[left])
        rank_left = np.where(left >= 0, lookup(vocab, beside, made)[1], NONE)
        rank_right = np.where(right < n, lookup(vocab, made, symbol[np.minimum(right, n - 1)])[1], NONE)
        holds = np.flatnonzero(np.minimum(rank_left, rank_right) <= r)
        if len(holds) and holds[0] + 1 < len(at):
            rest, at = np.concatenate([rest, at[holds[0] + 1 :]]), at[: holds[0] + 1]
            made, second, right = piece[at], behind[at], behind[behind[at]]
        symbol[at], alive[second], behind[at] = made, False, right
        before[right[right < n]] = at[right < n]
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        pair = touched[behind[touched] < n]
        rank[touched] = NONE
        piece[pair], rank[pair] = lookup(vocab, symbol[pair], symbol[behind[pair]])
        wait(touched)
        wait(np.setdiff1d(rest[alive[rest]], touched))
    return symbol[alive]


def _as_ids(vocab: Vocabulary, symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids: characters that are no piece (negative: -1 - code point) as their UTF-8 bytes."""
    raw = (symbol < 0) | (symbol >= vocab.size)
    if not raw.any():
        return symbol, offsets
    code = np.where(symbol < 0, -1 - symbol, 0).astype(np.int64)
    named = symbol >= vocab.size
    code[named] = vocab.extra[symbol[named] - vocab.size]
    length = np.where(raw, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
    to = np.concatenate([[0], np.cumsum(length)])
    out = np.repeat(symbol, length)
    k = np.arange(len(out)) - np.repeat(to[:-1], length)
    of, n = np.repeat(code, length), np.repeat(length, length)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    byte = np.where(k == 0, lead | (of >> (6 * (n - 1))), 0x80 | ((of >> (6 * (n - 1 - k))) & 0x3F))
    spelled = np.repeat(raw, length)
    out[spelled] = vocab.byte_ids[byte[spelled]]
    return out, to[offsets]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start[k] : start[k] + length[k]], one after another."""
    to = np.cumsum(length) - length
    return flat[np.repeat(start - to, length) + np.arange(int(length.sum()))]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 texts; bytes that are no UTF-8 become U+FFFD."""
    try:
        text = data.tobytes().decode()
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        text, at = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at.astype(np.int64)


def encode_texts(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of UTF-8 texts, each with the end id behind it if `end`."""
    code, at = code_points(data, offsets)
    full = np.flatnonzero(np.diff(at) > 0)
    code = np.insert(code, at[full], SPACE)
    at = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
    code[code == 32] = SPACE
    n_texts = len(at) - 1
    if len(code):
        # Words: no piece reaches over their ends, so they merge each for itself.
        alone = vocab.alone[code]
        start = alone.copy()
        start[1:] |= alone[:-1]
        if vocab.cut_at_space:
            start[1:] |= (code[1:] == SPACE) & (code[:-1] != SPACE)
        start[at[full]] = True
        first = np.flatnonzero(start)
        bounds = np.append(first, len(code)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds * 4), pa.py_buffer(code)]).dictionary_encode()
        letters, spans = utf8(words.dictionary)
        letters, spans = np.frombuffer(letters.tobytes(), np.uint32), spans // 4
        symbol = vocab.symbol_of[letters]
        symbol = np.where(symbol < 0, -1 - letters.astype(np.int64), symbol).astype(np.int32)
        flat, spans = _as_ids(vocab, *merge_words(vocab, symbol, spans))
        index = words.indices.to_numpy()
        length = np.diff(spans)[index]
        ids = gather(flat, spans[:-1][index], length)
        tokens = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(first, at)]
    else:
        ids, tokens = np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
    if end:
        ids = np.insert(ids, tokens[1:], vocab.end)
        tokens = tokens + np.arange(n_texts + 1)
    return ids.astype(np.int32), tokens


def _decode_one(vocab: Vocabulary, ids: list[int]) -> str:
    """As `decode_ids`, one id after another, for lists whose bytes make no whole characters."""
    codecs.register_error("each-byte", lambda error: ("�", error.start + 1))
    out, run = [], b""
    for i in ids:
        body = vocab.body[vocab.body_at[i] : vocab.body_at[i + 1]].tobytes()
        if vocab.byte[i]:
            run += body
            continue
        out.append(run.decode(errors="each-byte"))
        run = b""
        if not vocab.control[i]:
            first = vocab.spaced[i] and not any(out) and None not in out
            out += [None, body.decode()[1:] if first else body.decode()]  # None: a piece was shown
    return "".join(x or "" for x in [*out, run.decode(errors="each-byte")])


def decode_ids(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of id lists. Bytes that make no character become U+FFFD, each by itself.

    Control ids show nothing, but bytes before and behind one make no character together.
    """
    if (vocab.control[ids[:-1]] & vocab.byte[ids[1:]]).any():
        return pa.array([_decode_one(vocab, ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    length = np.diff(vocab.body_at)[ids]
    start = vocab.body_at[ids]
    shown = np.flatnonzero(~vocab.control[ids])
    k = np.searchsorted(shown, offsets[:-1])
    has = (k < len(shown)) & (np.append(shown, len(ids))[k] < offsets[1:])
    lead = shown[k[has]]
    lead = lead[vocab.spaced[ids[lead]]]  # the blank put before a text goes
    start[lead] += 1
    length[lead] -= 1
    body = gather(vocab.body, start, length)
    at = np.concatenate([[0], np.cumsum(length)])[offsets].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(body))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([_decode_one(vocab, ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    return texts.cast(pa.string())


def _mapped(df: DataFrame, name: str, kind, run) -> DataFrame:
    """`df` with a column that `run` makes of each table of a batch's size."""
    fields = [f for f in df.schema.fields if f.name != name]
    schema = StructType([*fields, StructField(name, kind)])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(given, BATCH_BYTES):
            table = table.combine_chunks()
            column = run(table)
            kept = table.select([f.name for f in fields])
            yield from kept.append_column(name, column).combine_chunks().to_batches()

    return df.mapInArrow(batches, schema)


def encode_pieces(df: DataFrame, model: str, text: str = "text", out: str = "ids", *, end: bool = True) -> DataFrame:
    """`df` with its texts' ids in `out` (array of int), as the sentencepiece library encodes them.

    Whole texts are encoded, however long; no sampling. Null counts as empty; an empty text
    has the end id alone (with `end`). Repeated rows are encoded each; other columns come back
    as they are, but one named `out` is replaced. An empty table gives an empty table. The
    model file is read once by the driver, and its tables (some 8 MB) go to the executors.
    There is no shuffle; a text without any blank or sign costs no more a byte than others.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(table: pa.Table) -> pa.Array:
        ids, offsets = encode_texts(sent.value, *utf8(table[text]), end)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _mapped(df, out, ArrayType(IntegerType()), run)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of each id list in `out`, as the library's decode gives it.

    A null or empty list gives an empty text, null ids inside a list are left out, ids that
    the model doesn't have raise an IndexError.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(table: pa.Table) -> pa.Array:
        lists = table[ids].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if flat.null_count:
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            offsets, flat = np.concatenate([[0], np.cumsum(there)])[offsets], flat.drop_null()
        values = flat.to_numpy()
        if len(values) and (values.min() < 0 or values.max() >= sent.value.size):
            raise IndexError("an id that the model doesn't have")
        return decode_ids(sent.value, values, offsets)

    return _mapped(df, out, StringType(), run)
