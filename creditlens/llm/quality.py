"""Quality rules as a short-circuit cascade.

A rule rejects documents by one measure. On a sample the cost of each measure and the rows each rule rejects are
estimated; the cascade then runs the rules by rejections per second, each counted among the rows that the earlier rules
leave, and a document that one rule rejects is not measured by the next. The order changes the cost only: the verdict is that of
all rules together, for every document and over its whole text.

Work is narrow: no shuffle, a bounded number of text bytes at once per task. Edge cases: a null or empty text has no words and
all counts 0; a document of any length is one unit of work; repeated rows are judged alike; an empty table gives an empty
result (and any order of rules); columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens.llm.text import Words, chunks, mixed, window_hashes

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SAMPLE_ROWS = 400
WINDOW = 5


class Batch:
    """Some documents with what several measures share."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words = Words(texts)
        self._hashes = None

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.words.hashes()
        return self._hashes


def _per_text(batch: Batch, flags: np.ndarray) -> np.ndarray:
    """Sums of a flag per byte over each text."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[np.minimum(batch.words.text_start[1:], len(flags))] - sums[np.minimum(batch.words.text_start[:-1], len(flags))]


def n_words(batch: Batch, rows: np.ndarray) -> np.ndarray:
    return batch.words.count[rows]


def word_chars(batch: Batch, rows: np.ndarray) -> np.ndarray:
    """Code points in words: all that start a character and are no blank."""
    bytes_ = batch.words.buffer
    blank = (bytes_ == 32) | ((bytes_ >= 9) & (bytes_ <= 13))
    return _per_text(batch, ((bytes_ & 0xC0) != 0x80) & ~blank)[rows]


def n_symbols(batch: Batch, rows: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    return _per_text(batch, table[batch.words.buffer])[rows]


def n_dup_lines(batch: Batch, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        lines = [x for x in batch.texts[r].split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines))
    return out


def _doubled(keys: np.ndarray) -> np.ndarray:
    """Flags of the entries whose key occurs again."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def n_repeat_words(batch: Batch, rows: np.ndarray) -> np.ndarray:
    """Words that a window of five covers which is found twice or more in the text."""
    words, wanted = batch.words, np.zeros(len(batch.texts), bool)
    wanted[rows] = True
    keys, doc = window_hashes(batch.hashes(), WINDOW), words.doc()
    start = np.flatnonzero((words.left()[: len(keys)] >= WINDOW) & wanted[doc[: len(keys)]])
    hit = start[_doubled(mixed(keys[start] + mixed(doc[start].astype(np.uint64))))]
    steps = np.bincount(hit, minlength=len(doc) + WINDOW) - np.bincount(hit + WINDOW, minlength=len(doc) + WINDOW)[: len(doc) + WINDOW]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps)[: len(doc)] > 0)])
    return (covered[words.first[1:]] - covered[words.first[:-1]])[rows]


def n_letter_words(batch: Batch, rows: np.ndarray) -> np.ndarray:
    """Words with a letter: A-Z, a-z or any character beyond ASCII."""
    bytes_ = batch.words.buffer
    letter = (bytes_ >= 128) | (((bytes_ | 32) >= 97) & ((bytes_ | 32) <= 122))
    sums = np.concatenate([[0], np.cumsum(letter)])
    has = np.concatenate([[0], np.cumsum(sums[batch.words.stop] > sums[batch.words.start])])
    return (has[batch.words.first[1:]] - has[batch.words.first[:-1]])[rows]


def n_distinct_words(batch: Batch, rows: np.ndarray) -> np.ndarray:
    words, wanted = batch.words, np.zeros(len(batch.texts), bool)
    wanted[rows] = True
    doc = words.doc()
    own = wanted[doc]
    keys = mixed(batch.hashes()[own] + mixed(doc[own].astype(np.uint64)))
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(doc[own][first], minlength=len(batch.texts))[rows]


def n_lines(batch: Batch, rows: np.ndarray) -> np.ndarray:
    return _per_text(batch, batch.words.buffer == 10)[rows] + 1


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``reject(measure, number of words)`` holds."""

    name: str
    measure: Callable
    reject: Callable


# The two base rules, then the rules of the cascade's own verdict. Limits leave wide room around ordinary prose.
RULES = (
    Rule("few_words", n_words, lambda x, n: n < 10),
    Rule("repeats", n_repeat_words, lambda x, n: 100 * x > 20 * n),
    Rule("symbols", n_symbols, lambda x, n: 100 * x > 20 * n),
    Rule("lines", n_dup_lines, lambda x, n: (x >= 3) & (10 * x > n)),
    Rule("word_length", word_chars, lambda x, n: (x < 2 * n) | (x > 20 * n)),
    Rule("letters", n_letter_words, lambda x, n: 100 * x < 40 * n),
    Rule("distinct", n_distinct_words, lambda x, n: (n >= 100) & (100 * x < 5 * n)),
)
BASE_RULES = ("few_words", "repeats")
MEASURES = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}


def _batches(texts: pa.Array) -> Iterator[tuple[int, Batch]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for start, stop in chunks(sizes):
        yield start, Batch([x or b"" for x in texts.slice(start, stop - start).to_pylist()])


def _estimate(rules: tuple[Rule, ...]):
    def run(parts):
        for part in parts:
            for _, batch in _batches(part.column(0)):
                rows = np.arange(len(batch.texts))
                columns = []
                for rule in rules:
                    batch._hashes = None
                    began = time.perf_counter()
                    bad = rule.reject(rule.measure(batch, rows), batch.words.count)
                    columns.append((bad, (time.perf_counter() - began) / len(rows)))
                bits = sum(bad.astype(np.int64) << i for i, (bad, _) in enumerate(columns))
                cost = pa.array([[c for _, c in columns]] * len(rows), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), cost], ["bits", "cost"])

    return run


def cascade_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, ordered by rejected rows per second among the rows still left, on a sample of bounded size.

    Only rule bits and times of ``sample_rows`` rows reach the driver.
    """
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).sample(0.1, 7).limit(sample_rows)
    found = sample.mapInArrow(_estimate(rules), "bits long, cost array<double>").collect()
    left = np.array([r.bits for r in found], np.int64)
    cost = np.mean([r.cost for r in found], axis=0) if found else np.ones(len(rules))
    order, open_ = [], list(range(len(rules)))
    while open_:
        gain = [((left >> i) & 1).sum() / max(cost[i], 1e-9) for i in open_]
        best = open_.pop(int(np.argmax(gain)))
        order.append(rules[best].name)
        left = left[((left >> best) & 1) == 0]
    return order


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, measures=tuple(BASE)) -> DataFrame:
    """``docs`` with the ``measures`` (of all rows), base_failed and kept."""
    order = order or cascade_order(docs, text, rules)
    by_name = {r.name: r for r in rules}
    base = [by_name[x] for x in order if x in BASE_RULES]
    rest = [by_name[x] for x in order if x not in BASE_RULES]
    docs = docs.drop(*[c for c in (*measures, "base_failed", "kept") if c != text])
    index = docs.columns.index(text)
    names = docs.columns
    measure_of = {m: MEASURES[m] for m in measures}

    def run(parts):
        for part in parts:
            column = part.column(index)
            texts = column.cast(pa.binary()) if column.type == pa.string() else column.cast(pa.large_binary())
            for start, batch in _batches(texts):
                every = np.arange(len(batch.texts))
                known = {f: f(batch, every) for f in measure_of.values()}
                alive = np.ones(len(every), bool)

                def apply(group):
                    for rule in group:
                        rows = np.flatnonzero(alive)
                        value = known[rule.measure][rows] if rule.measure in known else rule.measure(batch, rows)
                        alive[rows[rule.reject(value, batch.words.count[rows])]] = False

                apply(base)
                base_failed = ~alive
                apply(rest)
                own = part.slice(start, len(every))
                added = [pa.array(known[f], pa.int64()) for f in measure_of.values()] + [pa.array(base_failed), pa.array(alive)]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], [*names, *measure_of, "base_failed", "kept"])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in [*((m, T.LongType()) for m in measure_of), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]:
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
