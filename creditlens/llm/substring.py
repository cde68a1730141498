"""Substring deduplication with prefix-partitioned suffix trees.

A word goes if a window of 35 consecutive words covers it whose words also start somewhere else, in another document or
the same one. The suffixes of all texts are taken word by word:

1. Anchors. Of the 28 places of 8 words in a window the one with the lowest hash is its anchor. Equal windows
   have equal anchors, so suffixes need to be held only from anchors on (about one word in 14), each with the words before it that its
   windows reach.
2. Prefixes. The 8 words at an anchor are the prefix of its suffix. Prefixes are counted over all documents; a suffix whose prefix is
   unique is a leaf too high to matter and is left out.
3. Memory-sized groups. Prefixes are dealt to bins by hash, the number of bins growing with the number of suffixes. A bin's subtrees are built
   top down, all at once: level by level the nodes are split by the next word, to the right of the anchors and, for the words
   before them, to the left. A window is repeated if the pair of left and right nodes that spell its 35 words has two leaves or more: these are the
   deep internal nodes, and neighbouring ones are maximal repeats.
4. Longer prefixes. A prefix with more than ``GROUP_LIMIT`` suffixes is extended to the full 35 words. All windows of an anchor are one run, and
   the windows of equal runs are listed once, with the number of the runs, so copies cost a row per anchor, and repeats inside a document none. A window is repeated if its runs
   add up to two or more; such places are joined back to the runs.
5. Removal. The covered words of each document are dropped.

Words are compared by 64-bit hashes, whole windows and runs of step 4 by two of them.

Edge cases: a null text has no words; texts below 35 words keep all; repeated rows count as other places, so both lose
all their words if long enough; a very long text is one unit of work; an empty table gives an empty result; other columns are not used, a null id stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.llm.text import Words, chunks, mixed, window_hashes, with_row_key
from creditlens.session import write_stage

WINDOW = 35
PREFIX = 8
GROUP_LIMIT = 4_000
BIN_ROWS = 20_000
PLACES = WINDOW - PREFIX + 1

_PLACE_BITS = np.uint64((1 << 28) - 1)
_ANCHOR = "struct<prefix:bigint,long_prefix:boolean,start:int,offset:int,windows:int>"
_WINDOWS = "array<struct<one:bigint,two:bigint>>"
KEY = ["row_file", "row_no"]


def anchors_of(words: Words, hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """(prefix hash, anchor, first window, number of windows) of each anchor; places count words in the batch."""
    starts = np.flatnonzero(words.left() >= window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    keys = window_hashes(hashes, prefix)
    # Order by the upper hash bits, then by place: the leftmost lowest one, whatever lies around the window.
    low = (keys & ~_PLACE_BITS) | np.arange(len(keys), dtype=np.uint64)
    places, width = window - prefix + 1, 1
    while 2 * width <= places:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = places - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low[starts] & _PLACE_BITS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return keys[anchor[first]].view(np.int64), anchor[first], starts[first], np.diff(np.append(first, len(starts)))


def _texts(part: pa.RecordBatch, column: str):
    """Chunks (start, texts) of a batch."""
    values = part.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    for start, stop in chunks(sizes):
        yield start, [x or b"" for x in values.slice(start, stop - start).to_pylist()]


def _find_anchors(parts):
    for part in parts:
        file, no = part.column("row_file").to_numpy(), part.column("row_no").to_numpy()
        for at, texts in _texts(part, "text"):
            words = Words(texts)
            prefix, anchor, start, windows = anchors_of(words, words.hashes())
            doc = words.doc()[anchor]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (
                    prefix, file[at + doc], no[at + doc], (start - words.first[doc]).astype(np.int32),
                    (anchor - start).astype(np.int32), windows.astype(np.int32),
                )],
                ["prefix", *KEY, "start", "offset", "windows"],
            )


def _kept_digest(words: Words, doc: int, keep: np.ndarray | None = None) -> str:
    rows = np.arange(words.first[doc], words.first[doc + 1])
    if keep is not None:
        rows = rows[keep]
    data = words.data
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(words.start[rows].tolist(), words.stop[rows].tolist())])).hexdigest()


def _split_hits(parts):
    """Documents without a repeated prefix are finished here; the others are passed on with their texts."""
    for part in parts:
        hit = np.array([x is not None for x in part.column("anchors").to_pylist()], bool) if part.num_rows else np.zeros(0, bool)
        for at, texts in _texts(part, "text"):
            own = hit[at : at + len(texts)]
            words = Words(texts)
            digests = [None if own[i] else _kept_digest(words, i) for i in range(len(texts))]
            rows = part.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in (*KEY, "doc_id")), pa.array(words.count, pa.int64()), pa.array(digests, pa.string()),
                    pa.array([t if h else None for t, h in zip(texts, own)], pa.binary()), rows.column("anchors"),
                ],
                [*KEY, "doc_id", "n_words", "kept_sha256", "text", "anchors"],
            )


def _anchor_rows(part: pa.RecordBatch, at: int, n: int, long_prefix: bool):
    """Anchors of some documents as flat arrays: document, prefix, start, offset, windows."""
    lists = part.column("anchors").slice(at, n)
    doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("prefix", "start", "offset", "windows")]
    own = flat.field("long_prefix").to_numpy(zero_copy_only=False) == long_prefix
    return doc[own], *(x[own] for x in columns)


def _contexts(parts):
    """For each anchor the words that its windows cover."""
    for part in parts:
        file, no = part.column("row_file").to_numpy(), part.column("row_no").to_numpy()
        for at, texts in _texts(part, "text"):
            doc, prefix, start, offset, windows = _anchor_rows(part, at, len(texts), False)
            if not len(doc):
                continue
            words = Words(texts)
            first = words.first[doc] + start
            last = first + windows + (WINDOW - 2)
            data = words.data
            context = [data[a:b] for a, b in zip(words.start[first].tolist(), words.stop[last].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix), pa.array(file[at + doc]), pa.array(no[at + doc]), pa.array(start), pa.array(offset), pa.array(windows), pa.array(context, pa.binary())],
                ["prefix", *KEY, "start", "offset", "windows", "context"],
            )


def _whole_windows(parts):
    """The windows of each anchor whose prefix was extended to the window, as two hashes each, and two hashes over all of them."""
    for part in parts:
        file, no = part.column("row_file").to_numpy(), part.column("row_no").to_numpy()
        for at, texts in _texts(part, "text"):
            doc, _, start, _, windows = _anchor_rows(part, at, len(texts), True)
            if not len(doc):
                continue
            words = Words(texts)
            hashes = words.hashes()
            one, two = window_hashes(hashes, WINDOW), window_hashes(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), WINDOW)
            first = np.cumsum(windows) - windows
            step = np.arange(int(windows.sum())) - np.repeat(first, windows)
            rows = words.first[np.repeat(doc, windows)] + np.repeat(start, windows) + step
            place = mixed((step + 1).astype(np.uint64))
            whole = [mixed(np.add.reduceat(mixed(x[rows] + place), first) + windows.astype(np.uint64)) for x in (one, two)]
            # One row for all places of a run in a document.
            order = np.lexsort((start, whole[1], whole[0], doc))
            ranked = [x[order] for x in (doc, *whole)]
            new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ranked], axis=0)]))
            starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array(start[order]))
            of = order[new]
            ends = np.concatenate([[0], np.cumsum(windows[of])])
            own = rows[np.repeat(first[of] - ends[:-1], windows[of]) + np.arange(ends[-1])]
            pairs = pa.StructArray.from_arrays([pa.array(x[own].view(np.int64)) for x in (one, two)], ["one", "two"])
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x[of].view(np.int64)) for x in whole), pa.array(file[at + doc[of]]), pa.array(no[at + doc[of]]), starts,
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs),
                ],
                ["whole_one", "whole_two", *KEY, "starts", "windows"],
            )


def _numbers(*keys: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... for the distinct rows of the key columns."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        ranked = k[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _levels(root: np.ndarray, hashes: np.ndarray, place: np.ndarray, step: int, depth: np.ndarray) -> list[np.ndarray]:
    """Tree nodes of all suffixes at each level, from ``root`` down: nodes split by the next word. A suffix that ends, or is alone in its node, stays
    a leaf with a number of its own."""
    n = len(root)
    node, levels = root.copy(), [root]
    alive = np.arange(n)
    next_id = int(node.max()) + 1 if n else 0
    for level in range(int(depth.max()) if n else 0):
        node = node.copy()
        ended = alive[depth[alive] <= level]
        node[ended] = next_id + np.arange(len(ended))
        next_id += len(ended)
        alive = alive[depth[alive] > level]
        if len(alive):
            number = _numbers(hashes[place[alive] + step * level], node[alive])
            node[alive] = next_id + number
            alone = np.bincount(number)[number] == 1
            next_id += int(number.max()) + 1
            alive = alive[~alone]
        levels.append(node)
    return levels


def repeated_windows(words: Words, prefix: np.ndarray, offset: np.ndarray, windows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Flags (anchor, window) of the windows that occur twice or more among the anchors with equal prefix."""
    hashes, first = words.hashes(), words.first[:-1]
    anchor = first + offset
    root = _numbers(prefix)
    right = _levels(root, hashes, anchor, 1, first + words.count - anchor)
    left = _levels(np.zeros(len(root), np.int64), hashes, anchor - 1, -1, offset)
    flags = np.zeros((len(root), int(windows.max()) if len(windows) else 0), bool)
    for back in range(int(offset.max()) + 1 if len(offset) else 0):
        # The windows that start ``back`` words before their anchor.
        rows = np.flatnonzero((offset >= back) & (offset - windows < back))
        if len(rows) > 1:
            pair = _numbers(right[window - back][rows], left[back][rows])
            flags[rows, offset[rows] - back] = np.bincount(pair)[pair] > 1
    return flags


def _build_subtrees(table: pa.Table) -> pa.Table:
    """Covered word ranges of the documents of one bin."""
    batch = table.combine_chunks()
    prefix, file, no, start, offset, windows = (batch.column(c).to_numpy() for c in ("prefix", *KEY, "start", "offset", "windows"))
    flags = repeated_windows(Words(batch.column("context").to_pylist()), prefix, offset.astype(np.int64), windows.astype(np.int64))
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return pa.table({
        "row_file": file[row], "row_no": no[row],
        "first": (start[row] + begin).astype(np.int32), "stop": (start[row] + end - 1 + WINDOW).astype(np.int32),
    })


def _remove(parts):
    for part in parts:
        ranges = part.column("ranges").to_pylist()
        for at, texts in _texts(part, "text"):
            words = Words(texts)
            removed, digests = [], []
            for i in range(len(texts)):
                n = int(words.count[i])
                steps = np.zeros(n + 1, np.int64)
                for r in ranges[at + i] or ():
                    steps[r["first"]] += 1
                    steps[r["stop"]] -= 1
                keep = np.cumsum(steps[:n]) == 0
                removed.append(n - int(keep.sum()))
                digests.append(_kept_digest(words, i, keep))
            rows = part.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", group_limit: int = GROUP_LIMIT, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs``."""
    rows = with_row_key(docs.select(F.col(row_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")))
    anchors = write_stage(
        rows.select(*KEY, "text").mapInArrow(_find_anchors, "prefix long, row_file long, row_no long, start int, offset int, windows int"), "anchors",
    )
    shared = write_stage(anchors.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1"), "prefixes")
    per_row = (
        anchors.join(shared, "prefix")
        .groupBy(*KEY).agg(F.collect_list(F.struct("prefix", (F.col("n") > group_limit).alias("long_prefix"), "start", "offset", "windows")).alias("anchors"))
    )
    split = write_stage(
        rows.join(per_row, KEY, "left").select(*KEY, "doc_id", "text", "anchors").mapInArrow(
            _split_hits, f"row_file long, row_no long, doc_id long, n_words long, kept_sha256 string, text binary, anchors array<{_ANCHOR}>",
        ), "hits",
    )
    hits = split.filter("anchors IS NOT NULL").select(*KEY, "text", "anchors")
    held = shared.filter(F.col("n") <= group_limit).agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-held // bin_rows))
    short = (
        hits.mapInArrow(_contexts, "prefix long, row_file long, row_no long, start int, offset int, windows int, context binary")
        .withColumn("bin", F.pmod(F.xxhash64("prefix"), F.lit(bins)))
        .groupBy("bin").applyInArrow(_build_subtrees, "row_file long, row_no long, first int, stop int")
    )
    runs = write_stage(hits.mapInArrow(_whole_windows, f"whole_one long, whole_two long, row_file long, row_no long, starts array<int>, windows {_WINDOWS}"), "runs")
    # Windows are listed once per distinct run of them, however many documents have it.
    whole_run = ["whole_one", "whole_two"]
    distinct = write_stage(runs.groupBy(*whole_run).agg(F.sum(F.size("starts")).alias("n"), F.first("windows").alias("windows")), "distinct-runs")
    windows = distinct.select(*whole_run, "n", F.posexplode("windows").alias("at", "window")).select(*whole_run, "n", "at", "window.*")
    twice = write_stage(windows.groupBy("one", "two").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"), "windows")
    # Written, so that a frequent run meets a plain table and adaptive execution can split its places.
    marked = write_stage(windows.join(twice, ["one", "two"]).groupBy(*whole_run).agg(F.collect_list("at").alias("at")), "marked-runs")
    places = F.flatten(F.transform("starts", lambda s: F.transform("at", lambda x: F.struct((s + x).alias("first"), (s + x + WINDOW).alias("stop")))))
    whole = runs.select(*whole_run, *KEY, "starts").join(marked, whole_run).select(*KEY, places.alias("ranges"))
    short = short.select(*KEY, F.array(F.struct("first", "stop")).alias("ranges"))
    ranges = short.unionByName(whole).groupBy(*KEY).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    finished = split.filter("anchors IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    cleaned = (
        split.filter("anchors IS NOT NULL").select(*KEY, "doc_id", "n_words", "text").join(ranges, KEY, "left")
        .select("doc_id", "n_words", "text", "ranges").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
    return finished.unionByName(cleaned)

