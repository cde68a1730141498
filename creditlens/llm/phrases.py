"""Phrase collocations from depth-truncated suffix subtrees that are built group by group.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces, and these at spaces and tabs into words. Every word begins a suffix; it is
truncated after three words or at the end of its piece. All counts are per language.

1. Vertical partitioning. Words, the prefixes of length one, are counted over all texts. A prefix with more suffixes than fit a share of the memory budget of a
   group is extended by the next word, and so again, up to three words; all other prefixes stay as they are. Which prefixes are extended
   is kept in two bitmaps of fixed size, so what all tasks receive does not grow with the texts; a prefix that meets a set bit by chance is extended too,
   which changes no count. The number of groups is the size of all suffixes by the budget, and prefixes are dealt to groups by hash.
2. Each batch of texts sends one row per group and language: its distinct truncated suffixes in order, with their counts. So a phrase with a third
   of all words is one entry per batch.
3. Subtrees. A group merges what it gets level by level, and the number of occurrences below each node, the total of its leaves, is the count of the
   phrase that leads to it. Groups need nothing from each other. Counts of prefixes that were extended are partial and are summed afterwards.
4. Phrases with enough occurrences are a table. Each cut of a candidate meets the counts of its two sides there; a candidate inside a longer one that is
   at least half as frequent goes. Arithmetic is in 38-digit decimals, so it is exact.

Edge cases: a null text has no words; a null language is ``und``; words may hold any other character; repeated rows count as often as they occur; a text
of any length is taken whole, in stretches that overlap by two words; an empty table gives an empty result; columns that are not named in the call are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlens.llm.text import byte_hashes, distinct_ranges, mixed
from creditlens.session import write_stage

LONGEST = 3
LEAST = 10
MILLION = 1_000_000
# Bytes of the texts whose suffixes one group takes, and words that one batch takes: a place in a batch's dictionary fits 21 bits.
GROUP_BYTES = 8_000_000
BATCH_BYTES = 2_000_000
BITS = 1 << 20
_ID = 21
_END = (1 << _ID) - 1

_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = 10
_FOLD = bytes(_FOLD)
_INK = np.ones(256, bool)
_INK[[9, 10, 32]] = False
_BLANK = re.compile(rb"[\x09\x0a\x20]")
# The rest of a suffix: the next words of the same piece.
_AHEAD = re.compile(rb"(?:[\x09\x20]*[^\x09\x0a\x20]+){0,%d}" % (LONGEST - 1))


def stretches(texts: Iterable[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, own) of the texts, folded and parted by line ends: about ``limit`` bytes each, of which words that begin before ``own`` count here.

    A long text is cut between words; the two words after the cut, if its piece goes on, follow as context.
    """
    waiting, size = [], 0
    for text in texts:
        text, at = text.translate(_FOLD), 0
        while len(text) - at > limit and (cut := _BLANK.search(text, at + limit)):
            yield text[at : _AHEAD.match(text, cut.start()).end()], cut.start() - at
            at = cut.start()
        waiting.append(text[at:])
        size += len(text) - at
        if size > limit:
            yield b"\n".join(waiting), size + len(waiting)
            waiting, size = [], 0
    if size:
        yield b"\n".join(waiting), size + len(waiting)


def word_ids(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Start, number of the piece and id of each word, and the words by id."""
    buffer = np.frombuffer(data, np.uint8)
    ink = _INK[buffer]
    edge = np.diff(np.concatenate([[0], ink.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ids, words = distinct_ranges(buffer, start, stop, ink)
    return start, np.cumsum(buffer == 10)[start], ids, words


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash per word and language; it deals prefixes to groups and never stands for a word."""
    return mixed(byte_hashes(words) ^ byte_hashes(pa.array([lang.encode()])))


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and one more word."""
    return mixed(prefix * np.uint64(3) + word)


def _spot(hashes: np.ndarray) -> np.ndarray:
    """Places in a bitmap."""
    return (hashes % np.uint64(BITS)).astype(np.int64)


def _prefix(first, second, third, long_words, long_pairs) -> np.ndarray:
    """Hash of the prefix of each suffix: one word, and one or two more where the bitmaps say so."""
    pair = _longer(first, second)
    more = long_words[_spot(first)]
    return np.where(more & long_pairs[_spot(pair)], _longer(pair, third), np.where(more, pair, first))


def _by_language(parts):
    """(lang, bytes, own) of the stretches of each batch, one language after the other."""
    for part in parts:
        langs = part.column("lang")
        for lang in sorted(pc.unique(langs).to_pylist()):
            values = part.column("text").filter(pc.equal(langs, lang))
            texts = (x for at in range(0, len(values), 100) for x in values.slice(at, 100).to_pylist())
            for data, own in stretches(texts):
                yield lang, data, own


def _count_words(often: float):
    """(lang, word, second, spot, n): the words of each batch, and the pairs that are more than ``often`` of it; spot is the place in the bitmap."""

    def run(parts):
        for lang, data, own in _by_language(parts):
            start, piece, ids, words = word_ids(data)
            mine = start < own
            counts = np.bincount(ids[mine], minlength=len(words))
            hashes = word_hashes(words, lang)
            known = np.flatnonzero(counts)
            if len(known):
                yield _counted(lang, words.take(pa.array(known)), pa.nulls(len(known), pa.binary()), hashes[known], counts[known])
            pair = mine[:-1] & (piece[1:] == piece[:-1])
            pairs, n = np.unique((ids[:-1] << _ID | ids[1:])[pair], return_counts=True)
            pairs, n = pairs[n >= max(2, often * len(ids))], n[n >= max(2, often * len(ids))]
            if len(n):
                a, b = pairs >> _ID, pairs & _END
                yield _counted(lang, words.take(pa.array(a)), words.take(pa.array(b)), _longer(hashes[a], hashes[b]), n)

    return run


def _counted(lang, word, second, hashes, n):
    spot = pa.array((hashes % np.uint64(BITS)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(n), pa.string()), word.view(pa.string()), second.view(pa.string()), spot, pa.array(n, pa.int64())],
        ["lang", "word", "second", "spot", "n"],
    )


def _pack(words: pa.Array, suffix: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted truncated suffixes of one group as compressed Arrow columns, with their own dictionary."""
    columns = [suffix >> 2 * _ID, suffix >> _ID & _END, suffix & _END]
    known, place = np.unique(np.concatenate([c[c != _END] for c in columns]), return_inverse=True)
    at, out = 0, []
    for c in columns:
        there = c != _END
        ids = np.full(len(c), -1, np.int32)
        ids[there] = place[at : at + there.sum()]
        at += there.sum()
        out.append(pa.array(ids))
    dictionary = words.take(pa.array(known))
    sink = pa.BufferOutputStream()
    fields = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("n", pa.int64())])
    table = pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64())], schema=fields)
    names = pa.RecordBatch.from_arrays([dictionary], ["word"])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in (names, table):
        with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    source = pa.BufferReader(data)
    names = pa.ipc.open_stream(source).read_all()
    table = pa.ipc.open_stream(source).read_all()
    return names.column("word").combine_chunks(), [table.column(c).to_numpy() for c in ("a", "b", "c", "n")]


def _deal(groups: int, extended):
    """(group, lang, suffixes) of each batch; ``extended`` holds the bitmaps of words and of pairs whose prefixes are extended."""

    def run(parts):
        for lang, data, own in _by_language(parts):
            start, piece, ids, words = word_ids(data)
            hashes = word_hashes(words, lang)
            second = np.where(np.append(piece[1:], -1) == piece, np.append(ids[1:], _END), _END)
            third = np.where((np.append(piece[2:], [-1, -1])[: len(piece)] == piece) & (second != _END), np.append(ids[2:], [_END, _END])[: len(ids)], _END)
            # A suffix of one word says nothing that the count of the words does not.
            use = (start < own) & (second != _END)
            suffix, n = np.unique((ids << 2 * _ID | second << _ID | third)[use], return_counts=True)
            if not len(suffix):
                continue
            a, b, c = suffix >> 2 * _ID, suffix >> _ID & _END, suffix & _END
            third_hash = np.append(hashes, np.uint64(1))[np.minimum(c, len(hashes))]
            group = (mixed(_prefix(hashes[a], hashes[b], third_hash, *extended.value)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
            rows = [order[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(group[r[0]]) for r in rows], pa.int32()), pa.array([lang] * len(rows), pa.string()),
                    pa.array([_pack(words, suffix[r], n[r]) for r in rows], pa.binary()),
                ],
                ["group", "lang", "suffixes"],
            )

    return run


def subtree_counts(packed: list[bytes]) -> tuple[pa.Array, list[tuple[list[np.ndarray], np.ndarray]]]:
    """The words, and for depth two and three the nodes (one array of word ids per depth) with the totals of their leaves."""
    read = [_unpack(x) for x in packed]
    coded = pa.concat_arrays([w for w, _ in read]).dictionary_encode()
    place, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    columns, at = [], 0
    for own, (a, b, c, n) in read:
        ids = np.append(place[at : at + len(own)], -1)
        at += len(own)
        columns.append((ids[a] << 31 | ids[b], ids[c], n))
    pair, third, n = map(np.concatenate, zip(*columns))
    pairs, number = np.unique(pair, return_inverse=True)
    # The children of each node of depth two; suffixes that end there have no third word.
    deep = third >= 0
    triple, leaf = np.unique(number[deep] << 31 | third[deep], return_inverse=True)
    above = pairs[triple >> 31]
    low = (1 << 31) - 1
    return words, [
        ([pairs >> 31, pairs & low], _totals(number, n, len(pairs))),
        ([above >> 31, above & low, triple & low], _totals(leaf, n[deep], len(triple))),
    ]


def _totals(node: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, node, n)
    return out


def _grow(least: int, extended):
    """(lang, phrase, size, n) of the nodes of one group's subtrees; whole counts below ``least`` are left out."""

    def run(table):
        long_words, long_pairs = extended.value
        langs, suffixes = (table.column(c).combine_chunks() for c in ("lang", "suffixes"))
        out = []
        for lang in sorted(pc.unique(langs).to_pylist()):
            words, levels = subtree_counts(suffixes.filter(pc.equal(langs, lang)).to_pylist())
            hashes = word_hashes(words, lang)
            for ids, n in levels:
                keep = n >= least
                if len(ids) == 2:
                    # Only a pair whose prefix was extended to three words lies in several groups.
                    a, b = hashes[ids[0]], hashes[ids[1]]
                    keep |= long_words[_spot(a)] & long_pairs[_spot(_longer(a, b))]
                texts = pc.binary_join_element_wise(*[words.take(pa.array(i[keep])) for i in ids], pa.scalar(b" ", pa.binary()))
                m = len(texts)
                out.append(pa.table({
                    "lang": pa.array([lang] * m, pa.string()), "phrase": texts.view(pa.string()), "size": pa.array([len(ids)] * m, pa.int32()), "n": pa.array(n[keep], pa.int64()),
                }))
        return pa.concat_tables(out)

    return run


def _bitmap(spots: DataFrame) -> np.ndarray:
    """A flag per place of the bitmap; no more than its fixed size reaches the driver."""
    flags = np.zeros(BITS, bool)
    flags[[r.spot for r in spots.select("spot").distinct().collect()]] = True
    return flags


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, group_bytes: int = GROUP_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of one to three words that occur ``least`` times, and (lang, n) with the number of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    # A prefix may fill a tenth of a group.
    share = 1 / (10 * groups)
    counted = rows.mapInArrow(_count_words(share / 2), "lang string, word string, second string, spot int, n long")
    words = write_stage(counted.groupBy("lang", "word", "second", "spot").agg(F.sum("n").alias("n")), "phrase-words")
    single, pairs = words.filter("second IS NULL"), words.filter("second IS NOT NULL")
    totals = write_stage(single.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    enough = share * (totals.agg(F.sum("n")).first()[0] or 0)
    extended = spark.sparkContext.broadcast((_bitmap(single.filter(F.col("n") > enough)), _bitmap(pairs.filter(F.col("n") > enough / 2))))
    dealt = rows.mapInArrow(_deal(groups, extended), "group int, lang string, suffixes binary")
    nodes = dealt.groupBy("group").applyInArrow(_grow(least, extended), "lang string, phrase string, size int, n long")
    longer = nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ones = single.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return write_stage(longer.unionByName(ones), "phrases"), totals


def scored(phrases: DataFrame, half: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words that no longer one with ``half`` percent of their occurrences holds."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    several = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"),
    )
    for side in ("left", "right"):
        counts = phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0]))
        cuts = cuts.join(counts, ["lang", side])
    million = F.lit(MILLION).cast("decimal(38,0)")
    cuts = cuts.withColumns({"top": million * exact("a") * exact("a"), "bottom": exact("l") * exact("r")}).withColumn("score", F.expr("top div bottom"))
    # The parts of a longer phrase: all but its last word, all but its first.
    inside = several.filter("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    both = cuts.select("lang", "phrase", "a", F.struct("score", "cut", "l", "r").alias("way"), F.lit(None).cast("long").alias("longer")).unionByName(
        inside.select("lang", "phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast("struct<score:bigint,cut:int,l:bigint,r:bigint>").alias("way"), F.col("a").alias("longer"))
    )
    best = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("way").alias("way"), F.max("longer").alias("longer"))
    kept = best.filter(F.col("longer").isNull() | (100 * exact("longer") < half * exact("a")))
    return kept.select("lang", "phrase", "a", "way.l", "way.r", "way.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = 2_000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, then frequency, then text."""
    phrases, totals = phrase_counts(docs, text, lang, least, **options)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language is ranked in slices first, so that one with all candidates is no single task.
    sliced = scored(phrases).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    heads = sliced.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("place") <= first)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
