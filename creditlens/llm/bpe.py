"""Byte-level BPE encoding and decoding by batched merge rounds in NumPy.

The words of many documents are told apart first, so each distinct word is merged once. The symbols of all new words lie in one
flat array; a round looks up all neighbouring pairs by binary search over the sorted pair keys, takes each word's lowest rank, and merges all its places from
left to right. Words without a pair left leave the array. A merge of rank r only makes pairs of higher rank, since the merges are listed in
the order in which their parts came to be, so merging all equal pairs of a round at once gives the result of merging one by one.

The vocabulary file is a parameter; the driver reads it once and ships two small arrays (its size is that of the vocabulary, never
of the data). Work is narrow: no shuffle, and the arrays of a merge round hold a bounded stretch of text.

Edge cases: a null text is empty and has no tokens; a text of any length is encoded whole; the added token inside a text gets its
own id as in the tokenizers library; equal rows get equal results; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creditlens.llm.text import chunks, distinct_ranges

# White space of Unicode; letters and numbers are the general categories L and N.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK, BREAK = range(5)
# Letters that an apostrophe before them takes along.
_TAKEN = ("s", "t", "m", "d", "re", "ve", "ll")

# Characters that are encoded at once; a longer text is cut where a run of blanks begins, which ends a word whatever lies around it.
CHUNK_CHARS = 500_000
_NONE = np.iinfo(np.int32).max
_CLASS = "".join(map(regex.escape, map(chr, _BLANKS)))
_CUT = regex.compile(f"(?<=[^{_CLASS}])[{_CLASS}]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


def character_kinds() -> np.ndarray:
    """Kind of every code point; U+10FFFF is the break between texts."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[[ord(c) for c in regex.findall(pattern, every)]] = kind
    kinds[_BLANKS] = BLANK
    kinds[0x10FFFF] = BREAK
    return kinds


@dataclass(frozen=True)
class Vocabulary:
    """What the merge rounds need: ids of bytes, sorted pair keys with ranks and results, bytes of each id, added tokens."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    id_bytes: list
    added: dict
    kinds: np.ndarray

    @property
    def added_pattern(self):
        return regex.compile("|".join(map(regex.escape, self.added)))

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        ids, letters = content["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        id_bytes = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            id_bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            id_bytes[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([pair_key(ids[a], ids[b]) for a, b in merges], np.int64)
        order = np.argsort(keys)
        return Vocabulary(
            np.array([ids[letters[b]] for b in range(256)], np.int32), keys[order], order.astype(np.int32),
            np.array([ids[a + b] for a, b in merges], np.int32)[order], id_bytes, added, character_kinds(),
        )


def pair_key(a, b):
    return (np.int64(a) << 32) | b if np.isscalar(a) else (a.astype(np.int64) << 32) | b


def _look_up(symbols: np.ndarray, owner: np.ndarray, rows: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Place among the sorted pair keys and rank of the pairs that begin at ``rows``; no rank if the word ends there."""
    after = np.minimum(rows + 1, len(symbols) - 1)
    keys = pair_key(symbols[rows], symbols[after])
    at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
    known = (v.pair_keys[at] == keys) & (after > rows) & (owner[rows] == owner[after])
    return at, np.where(known, v.pair_ranks[at], _NONE)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    done_symbols, done_owner = [], []
    here = np.arange(len(symbols))
    at, rank = _look_up(symbols, owner, here, v)
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.minimum.reduceat(rank, first)
        best = np.repeat(lowest, np.diff(np.append(first, len(symbols))))
        open_ = best != _NONE
        go = (rank == best) & open_
        # Of overlapping places of one pair (a a a) the first, third, ... are merged.
        if (go[1:] & go[:-1]).any():
            here = np.arange(len(go))
            go &= (here - np.maximum.accumulate(np.where(go, -1, here))) % 2 == 1
        if not open_.all():
            done_symbols.append(symbols[~open_])
            done_owner.append(owner[~open_])
        symbols = np.where(go, v.pair_ids[at], symbols)
        keep = np.append(True, ~go[:-1]) & open_
        symbols, owner, at, rank, new = symbols[keep], owner[keep], at[keep], rank[keep], np.flatnonzero(go[keep])
        # Only the pairs of a new symbol and of the symbol before it have changed.
        flags = np.zeros(len(symbols), bool)
        flags[new] = True
        flags[new[new > 0] - 1] = True
        changed = np.flatnonzero(flags)
        at[changed], rank[changed] = _look_up(symbols, owner, changed, v)
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    all_owner = np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(all_owner, minlength=len(words))


def split_points(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the words in ``codes`` (code points, U+10FFFF breaks), by the public split pattern of these vocabularies.

    A word is a run of letters, of numbers or of other characters, with one space before it if there is one; blanks are
    a word without the last one before a word, which is a word of its own unless it is that space; an apostrophe
    that starts a word takes s, t, m, d, re, ve or ll along.
    """
    n = len(codes)
    kind = kinds[codes]
    before = np.concatenate([[BREAK], kind[:-1]])
    after = np.concatenate([kind[1:], [BREAK]])
    starts = (kind != before) | (kind == BREAK)
    # The last blank of a run that a word follows stands apart; a space moves the start of the word to itself.
    last = (kind == BLANK) & (after != BLANK) & (after != BREAK)
    starts |= last
    spaces = np.flatnonzero(last & (codes == 32))
    starts[spaces + 1] = False
    quote = np.flatnonzero((codes == 39) & starts & (after == LETTER))
    if len(quote):
        padded = np.concatenate([codes, [0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        length = np.zeros(len(quote), np.int64)
        for x in _TAKEN:
            hit = one == ord(x[0]) if len(x) == 1 else (one == ord(x[0])) & (two == ord(x[1]))
            length = np.where((length == 0) & hit, len(x), length)
        quote, length = quote[length > 0], length[length > 0]
        starts[quote + 1] = False
        more = quote + 1 + length
        inside = more < n
        starts[more[inside]] = True
    return np.flatnonzero(starts)


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start:start+count] of all ranges, one after the other."""
    stop = np.cumsum(count)
    return flat[np.repeat(start - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]


def _pieces(text: str, limit: int):
    """The text in pieces of about ``limit`` characters that are encoded apart."""
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(texts: list[str], v: Vocabulary, limit: int = CHUNK_CHARS) -> list[np.ndarray]:
    """Token ids of each text. U+10FFFF, a noncharacter, stands between texts; a text that holds it is encoded by itself."""
    parts, owner = [], []

    def add(i, text):
        for piece in _pieces(text, limit):
            parts.append(piece)
            owner.append(i)

    for i, text in enumerate(texts):
        at = 0
        for m in v.added_pattern.finditer(text) if v.added else ():
            add(i, text[at : m.start()])
            parts.append(m)
            owner.append(i)
            at = m.end()
        add(i, text[at:] if at else text)
    plain = [k for k, x in enumerate(parts) if isinstance(x, str) and "\U0010ffff" not in x]
    ids = [None] * len(parts)
    for start, stop in chunks([len(parts[k]) for k in plain], limit):
        for k, x in zip(plain[start:stop], _encode_plain([parts[k] for k in plain[start:stop]], v)):
            ids[k] = x
    for k, x in enumerate(parts):
        if ids[k] is None:
            ids[k] = _encode_plain([x], v, apart=False)[0] if isinstance(x, str) else np.array([v.added[x[0]]], np.int32)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [ids[a] if b - a == 1 else np.concatenate(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _encode_plain(texts: list[str], v: Vocabulary, apart: bool = True) -> list[np.ndarray]:
    if not texts:
        return []
    joined = "\U0010ffff".join([*texts, ""]) if apart else texts[0]
    if not joined:
        return [np.zeros(0, np.int32) for _ in texts]
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = joined.encode()
    kinds = v.kinds
    if not apart:
        kinds = v.kinds.copy()
        kinds[0x10FFFF] = OTHER
    point = split_points(codes, kinds)
    is_break = (codes[point] == 0x10FFFF) if apart else np.zeros(len(point), bool)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    start, stop = at[point], at[np.append(point[1:], len(codes))]
    words = ~is_break
    text_of = np.cumsum(is_break)[words]
    start, stop = start[words], stop[words]
    number, distinct = distinct_ranges(np.frombuffer(data, np.uint8), start, stop)
    flat, count = merge_words(distinct.to_pylist(), v)
    begin = np.cumsum(count) - count
    out = _gathered(flat, begin[number], count[number])
    sizes = np.bincount(text_of, weights=count[number], minlength=len(texts)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of the ids, added tokens included; broken UTF-8 becomes U+FFFD."""
    slices = (ids[at : at + CHUNK_CHARS].tolist() for at in range(0, len(ids), CHUNK_CHARS))
    return b"".join([b"".join(map(v.id_bytes.__getitem__, x)) for x in slices]).decode("utf-8", "replace")


def encode_frame(docs: DataFrame, vocabulary_path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and with ``keep_ids`` the ids themselves as token_ids."""
    spark = docs.sparkSession
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if keep_ids else [])]
    docs = docs.drop(*[c for c in added if c != text])
    # Plain values: a broadcast of an own class would need this package on the workers.
    shared = spark.sparkContext.broadcast(tuple(vars(Vocabulary.load(vocabulary_path)).values()))
    names, index = docs.columns, docs.columns.index(text)

    def run(parts):
        v = Vocabulary(*shared.value)
        for part in parts:
            column = part.column(index)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for start, stop in chunks(sizes, CHUNK_CHARS):
                texts = [x or "" for x in column.slice(start, stop - start).to_pylist()]
                ids = encode(texts, v)
                columns = [
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(decode(x, v).encode()).hexdigest() for x in ids], pa.string()),
                ]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                own = part.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*names, *added])

    schema = T.StructType(list(docs.schema.fields)).add("n_tokens", T.LongType())
    schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    if keep_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)
