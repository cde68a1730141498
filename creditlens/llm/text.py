"""Words, keys and word hashes shared by the operators of this subpackage.

A word is a longest run of characters other than the space and U+0009 to U+000D. ``bytes.split()`` and the byte table
below cut at exactly these six characters, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlens.session import write_stage

WORD = r"[^\x20\x09-\x0D]+"
SPAN = "array<struct<start:bigint,stop:bigint,kind:int,found:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Text bytes that NumPy handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASE = 0xD6E8FEB86659FD93
# Bytes from which on a word is hashed by itself.
_LONG_WORD = 256


def lower_ascii(text: Column) -> Column:
    """The text with A-Z as a-z and all else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file: only scans, projections and filters, no rows multiplied or made."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        docs.explain("simple")
    nodes = re.findall(r"^[\s:+*()0-9-]*([A-Z][A-Za-z]*(?: [a-z]+)?)", shown.getvalue(), re.M)
    return "FileScan parquet" in nodes and set(nodes) <= {"FileScan parquet", "Project", "Filter", "ColumnarToRow"}


def with_row_key(docs: DataFrame, file: str = "row_file", row: str = "row_no") -> DataFrame:
    """``docs`` with two longs that name a row for good, also when a task runs again or ids repeat; columns of these names are replaced.

    They are the hash of the file's path and the row's place in it. A frame that is more than rows read from Parquet files (joined, united,
    aggregated, made) is written to the shared folder first. Take the result of one call for all further work: a second call may write anew.
    """
    docs = docs.drop(file, row)
    if not _plain_scan(docs):
        docs = write_stage(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, block: int = 512) -> Column:
    """The running sums of an array of longs, in blocks: an array that grows by one in each step of a fold is copied each time."""

    def fold(own, start):
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(own, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda s: s["out"])

    def of_blocks(blocks):
        totals = F.transform(blocks, lambda b: F.element_at(b, -1))
        shifted = lambda before: F.transform(blocks, lambda b, i: let(
            F.when(i > 0, F.get(before, i - 1)).otherwise(0), lambda add: F.transform(b, lambda x: x + add)))
        return F.flatten(let(fold(totals, F.lit(0).cast("long")), shifted))

    def of(v):
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        return let(F.transform(starts, lambda at: fold(F.slice(v, at, block), F.lit(0).cast("long"))), of_blocks)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast("array<bigint>"))


def match_spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """Array of (start, stop, kind, found) of all ``matches`` of ``pattern`` in ``text``, in code points.

    Their places are the running lengths of the matches and of what lies between them.
    """
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
    spans = F.zip_with(running_sums(pieces), matches, lambda stop, m: F.struct(
        (stop - F.length(m)).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), m.alias("found")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPAN))


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``limit`` bytes together."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of a binary array: eight bytes after the other through a scrambling that is not linear."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    first = words.buffers()[1].to_pybytes() if words.offset else words.buffers()[1]
    first = int(np.frombuffer(first, np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset])
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8)[first : first + int(size.sum())], np.zeros(8, np.uint8)])
    out = mixed(size.astype(np.uint64) + np.uint64(_WORD_BASE))
    rows = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    at = 0
    while len(rows):
        block = data[(start[rows] + at)[:, None] + np.arange(8)].view("<u8")[:, 0]
        bits = (8 * np.minimum(size[rows] - at, 8)).astype(np.uint64)
        block &= np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
        out[rows] = mixed(out[rows] * np.uint64(_WORD_BASE) ^ mixed(block + np.uint64(at)))
        at += 8
        rows = rows[size[rows] > at]
    long = np.flatnonzero(size > _LONG_WORD)
    out[long] = [int.from_bytes(hashlib.blake2b(words[i].as_py(), digest_size=8).digest(), "little") for i in long.tolist()]
    return out


def distinct_ranges(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """For the ranges of a byte array, which follow each other, their ids and the distinct ones by id; compared byte for byte.

    ``inside`` flags the bytes in any range.
    """
    if inside is None:
        edge = np.zeros(len(buffer) + 1, np.int8)
        edge[start] = 1
        edge[stop] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate([[0], np.cumsum(stop - start)])
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    coded = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(buffer[inside])]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Words:
    """The words of some documents: byte ranges in one buffer, and per document its first word."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([*texts, b""])
        self.data = joined
        self.buffer = np.frombuffer(joined, np.uint8)
        self.ink = ~_BLANK[self.buffer]
        edge = np.diff(np.concatenate([[False], self.ink, [False]]).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Number of each word among the distinct words, and these."""
        return distinct_ranges(self.buffer, self.start, self.stop, self.ink)

    def hashes(self) -> np.ndarray:
        ids, distinct = self.ids()
        return byte_hashes(distinct)[ids]

    def left(self) -> np.ndarray:
        """How many words from each word on its document still has."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of words[i:i+k] for every i with k words to come, document ends ignored.

    Windows of doubling length are joined by a scrambling that is not linear, so no choice of words makes sums cancel.
    """
    if k < 1 or len(words) < k:
        return np.zeros(0, np.uint64)
    join = lambda left, right, n: mixed((left + np.uint64(n)) * np.uint64(_WORD_BASE) + right)
    out, size, power, width = None, 0, words, 1
    while True:
        if k & width:
            n = len(words) - size - width + 1
            out = power[:n] if out is None else join(out[:n], power[size : size + n], size)
            size += width
        if size == k:
            return mixed(out + np.uint64(k))
        power = join(power[:-width], power[width:], width)
        width *= 2
