"""Filter interaction audit by a Gray-code walk over all subsets of the filters.

1. Every row gets one flag per filter (true: it fails). Rows are counted per part and combination of flags, a mask: with five
   filters a part has at most 32 cells, whatever its number of rows. The counts are partial aggregates, so a part with a third of all rows
   sends 32 rows per task.
2. The walk visits the subsets of the filters in Gray code order, so one filter is toggled at a time. Each cell keeps the number
   of its failures among the active filters; the cells whose counter leaves or reaches zero change the running survivors. The survivors of every
   subset are stored (32 states).
3. The effect of a filter at any place of any order is the difference of two stored states. No order of the filters is ever run.

Copies: a row is a later copy if a smaller id has its text. The smallest id of every text meets the rows on digest (SHA-256) and id together, so
a text with a third of all rows is no hot key.

Edge cases: a null text is empty; a null part is the empty string; a null flag is no failure; a row with a null id is no later copy and
has no labels; equal ids are not smaller than each other, so repeated rows are no later copies; an id with several labels has a mark if one of them has
it; an empty table gives no rows; columns that are not named in the call are not used and may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlens.llm.text import WORD
from creditlens.session import write_stage

# All orders of the filters are reported, so there can only be a few.
MOST_FILTERS = 7


def text_flags(docs: DataFrame, text: str = "text", row_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(row_id, part, digest, A, B, C, D): what each text fails by itself. A few words, B few differing words, C loud, D symbols."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(row_id).alias("row_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("whole"),
        F.regexp_extract_all(whole, F.lit(WORD), 0).alias("words"),
    )
    n_words = F.size("words").cast("long")
    return rows.select(
        "row_id", "part", F.unhex(F.sha2(F.col("whole").cast("binary"), 256)).alias("digest"),
        (n_words < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * n_words).alias("B"),
        (100 * F.length(F.regexp_replace("whole", "[^A-Z]+", "")).cast("long") > 3 * F.length("whole").cast("long")).alias("C"),
        F.col("whole").rlike(r"[#$%&*|]").alias("D"),
    )


def with_later_copies(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with row_id and digest) with the flag ``name``: a smaller row_id has the same digest."""
    first = rows.filter("row_id IS NOT NULL").groupBy("digest").agg(F.min("row_id").alias("row_id")).withColumn("first", F.lit(True))
    with_id = rows.filter("row_id IS NOT NULL").join(first, ["digest", "row_id"], "left")
    return (
        with_id.withColumn(name, F.col("first").isNull()).drop("first")
        .unionByName(rows.filter("row_id IS NULL").withColumn(name, F.lit(False)))
    )


def with_marks(rows: DataFrame, labels: DataFrame, marks: Mapping[str, Column], row_id: str = "doc_id") -> DataFrame:
    """``rows`` with one flag per mark, a condition on ``labels``; false for rows without a label."""
    found = (
        labels.filter(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("row_id"))
        .agg(*[F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items()])
    )
    # Only labelled ids are sent to the labels, so rows without an id never meet in one task.
    joined = rows.filter("row_id IS NOT NULL").join(found, "row_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    return joined.unionByName(rows.filter("row_id IS NULL").withColumns({m: F.lit(False) for m in marks}))


def cells(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, cells): of each part one (mask, counts) per mask that occurs; counts holds all rows, then those with each mark."""
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    counts = [F.count("*"), *[F.count(F.when(F.col(m), 1)) for m in marks]]
    per_mask = rows.groupBy("part", mask.alias("mask")).agg(F.array(*counts).alias("counts"))
    return per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "counts")).alias("cells"))


def gray_states(masks: list[int], counts: list[list[int]], n_filters: int) -> list[list[int]]:
    """Survivors (one number per kind of count) of every subset of active filters, by the subset's mask."""
    running = [sum(c) for c in zip(*counts)]
    states = [None] * (1 << n_filters)
    failing = [0] * len(masks)
    active = 0
    states[0] = list(running)
    for step in range(1, 1 << n_filters):
        toggled = step & -step  # the bit in which neighbouring Gray codes differ
        active ^= toggled
        change = 1 if active & toggled else -1
        for i, mask in enumerate(masks):
            if mask & toggled:
                failing[i] += change
                if failing[i] == (1 if change == 1 else 0):
                    running = [r - change * c for r, c in zip(running, counts[i])]
        states[active] = list(running)
    return states


def order_rows(states: list[list[int]], masks: list[int], counts: list[list[int]], filters: list[str]) -> dict[str, list]:
    """The columns filter_order, step, kept, removed, redundant, unique_fails, lost (per mark) and shapley of all orders."""
    n = len(filters)
    failing = [sum(c[0] for m, c in zip(masks, counts) if m >> i & 1) for i in range(n)]
    unique = [sum(c[0] for m, c in zip(masks, counts) if m == 1 << i) for i in range(n)]
    shapley = [0] * n
    for subset, state in enumerate(states):
        size = subset.bit_count()
        for i in range(n):
            if not subset >> i & 1:
                # So many orders have exactly this subset before the filter.
                shapley[i] += factorial(size) * factorial(n - 1 - size) * (state[0] - states[subset | 1 << i][0])
    out = {k: [] for k in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "lost", "shapley")}
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = [a - b for a, b in zip(states[before], states[after])]
            row = ("".join(filters[k] for k in order), step, states[after][0], gone[0], failing[i] - gone[0], unique[i], gone[1:], shapley[i])
            for k, x in zip(out, row):
                out[k].append(x)
            before = after
    return out


def audit(rows: DataFrame, filters: list[str], marks: list[str] = ()) -> DataFrame:
    """Effects of the filters (flag columns of ``rows``, which has a column part) for every part, order of the filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost per mark, shapley): rows left after the step, removed
    by it, failing its filter but gone before, failing no other filter, removed and marked, and the sum of ``removed`` of the step's filter over all orders.
    """
    filters, marks = list(filters), list(marks)
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")

    def run(parts):
        for part in parts:
            for name, own in zip(part.column("part").to_pylist(), part.column("cells").to_pylist()):
                masks, counts = [c["mask"] for c in own], [c["counts"] for c in own]
                found = order_rows(gray_states(masks, counts, len(filters)), masks, counts, filters)
                lost = found.pop("lost")
                found |= {f"{m}_lost": [x[i] for x in lost] for i, m in enumerate(marks)}
                found = {"part": [name] * len(lost)} | found
                yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in types.items()], list(types))

    longs = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    types = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32()} | {c: pa.int64() for c in longs}
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in longs)
    return cells(rows, filters, marks).mapInArrow(run, schema)


def audit_documents(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E (E: later copies) with the marks good and toxic."""
    rows = with_later_copies(write_stage(text_flags(docs, text, row_id, part), "audit-flags"), "E").drop("digest")
    marked = with_marks(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, row_id)
    return audit(marked, list("ABCDE"), ["good", "toxic"])
