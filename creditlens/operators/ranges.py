"""Exact order statistics and running totals that never gather a column in one task.

A first pass sketches split points of each column, which give every task a slice of the value
range. The splits only balance the load, so results are exact whatever the sketch says. Equal
values collapse by a map-side count before anything is shuffled, so a value that fills a third
of all rows costs one row.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens.functions.numbers import missing_to_null

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 4096


def long_array(values) -> Column:
    """Literal array of whole numbers, parsed at once: making literals one by one is slow."""
    return F.expr("array(" + ", ".join(f"{int(v)}L" for v in values) + ")")


def _double_array(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)}D" for v in values) + ")")


class Splits:
    """Value count and split points of each column (bounded by ``MAX_RANGES`` numbers each)."""

    def __init__(self, counts: dict[str, int], cuts: dict[str, list[float]]):
        self.counts = counts
        self.cuts = cuts

    def add_range_columns(self, df: DataFrame, prefix: str = "_range_") -> DataFrame:
        """Whole-number range column per column; found by binary search in the split points."""
        split = [c for c in self.cuts if self.cuts[c]]
        if split:
            bucketizer = Bucketizer(
                inputCols=split,
                outputCols=[prefix + c for c in split],
                splitsArray=[[-math.inf, *self.cuts[c], math.inf] for c in split],
                handleInvalid="keep",
            )
            df = bucketizer.transform(df)
        whole = {
            prefix + c: F.col(prefix + c).cast("int") if self.cuts[c] else F.lit(0)
            for c in self.cuts
        }
        return df.withColumns(whole)


def find_splits(
    df: DataFrame,
    columns: list[str],
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
    counts: dict[str, int] | None = None,
) -> Splits:
    """Split points of ``columns``; none for a column short enough for one task.

    One pass counts the values, unless ``counts`` gives their numbers; a second one sketches the
    long columns, if there are any.
    """
    if counts is None:
        counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    counts = {c: counts[c] for c in columns}
    cuts: dict[str, list[float]] = {c: [] for c in columns}
    long = {c: min(max_ranges, math.ceil(n / rows_per_range)) for c, n in counts.items() if n > rows_per_range}
    if long:
        found = df.agg(*[
            F.percentile_approx(c, _double_array(i / n for i in range(1, n)), 4 * n).alias(c) for c, n in long.items()
        ]).first()
        for c in long:
            cuts[c] = sorted({p for p in found[c] if math.isfinite(p)})
    return Splits(counts, cuts)


def same_keys(columns: Sequence[str], prefix: str) -> Column:
    """Join condition: every column equals the one with the prefix; null equals null."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def running_totals(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct ``value`` (ascending order meant) with, for each measure, its sum there
    and its sum over all smaller values (``<name>_before``).

    ``measures`` are expressions to sum; they must be whole numbers for an exact result. With ``by`` the totals
    of each of its combinations (null is one) start anew; they share the slices of the value range, so a
    combination with most of the rows is spread over tasks like a single column.
    """
    by = list(by)
    prepared = df.select(*by, missing_to_null(F.col(value)).alias(value), *[m.alias(k) for k, m in measures.items()])
    prepared = prepared.where(F.col(value).isNotNull())
    splits = find_splits(prepared, [value], rows_per_range, max_ranges)
    part = "_range_" + value
    ranged = splits.add_range_columns(prepared)
    sums = [F.sum(k).cast("long").alias(k) for k in measures]
    per_value = ranged.groupBy(*by, part, value).agg(*sums)
    window = W.partitionBy(*by, part).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = {f"{k}_before": F.sum(k).over(window) - F.col(k) for k in measures}
    out = per_value.withColumns(before)
    if splits.cuts[value] and by:
        # At most MAX_RANGES rows per combination, which meet their rows in a join.
        earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
        starts = ranged.groupBy(*by, part).agg(*sums).select(
            *[F.col(c).alias("_start_" + c) for c in [*by, part]],
            *[(F.sum(k).over(earlier) - F.col(k)).alias("_start_" + k) for k in measures],
        )
        out = out.join(starts, same_keys([*by, part], "_start_"))
        out = out.withColumns({f"{k}_before": F.col(f"{k}_before") + F.col("_start_" + k) for k in measures})
    elif splits.cuts[value]:
        # At most MAX_RANGES rows of sums come back and go out again as literals.
        totals = {r[part]: r for r in ranged.groupBy(part).agg(*sums).collect()}
        n = len(splits.cuts[value]) + 1
        for k in measures:
            per_range = [(totals[i][k] or 0) if i in totals else 0 for i in range(n)]
            offsets = long_array([0, *accumulate(per_range)][:n])
            out = out.withColumn(f"{k}_before", F.col(f"{k}_before") + F.element_at(offsets, F.col(part) + 1))
    return out.select(*by, value, *measures, *before)


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of numeric columns, nulls left out; None for an empty column.

    Columns of at most ``rows_per_range`` values go through the built-in exact aggregate, whose
    buffer is bounded then. Of a longer column only the slices of the value range that hold a wanted
    rank are counted value by value. ``counts`` saves a pass if the numbers of values are known.
    """
    if not columns:
        return {}
    numeric = df.select([missing_to_null(F.col(c)).alias(c) for c in columns])
    splits = find_splits(numeric, columns, rows_per_range, max_ranges, counts)
    out = {}
    short = [c for c in columns if splits.counts[c] <= rows_per_range]
    if short:
        row = numeric.agg(*[F.percentile(c, _double_array(probs)).alias(c) for c in short]).first()
        out = {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in short}
    long = [c for c in columns if c not in short]
    return out | _long_quantiles(numeric, long, probs, splits) if long else out


def _long_quantiles(numeric: DataFrame, columns: list[str], probs: list[float], splits: Splits) -> dict[str, list[float]]:
    splits = Splits({c: splits.counts[c] for c in columns}, {c: splits.cuts[c] for c in columns})
    ranged = splits.add_range_columns(numeric)
    starts = _range_starts(ranged, splits)

    wanted: dict[tuple[int, int], set[int]] = {}
    for i, c in enumerate(columns):
        for rank in _ranks(splits.counts[c], probs):
            r = bisect_right(starts[c], rank) - 1
            wanted.setdefault((i, r), set()).add(rank - starts[c][r])
    picked = _values_at(ranged, columns, wanted)

    out = {}
    for i, c in enumerate(columns):
        n = splits.counts[c]
        values = []
        for p in probs:
            h = (n - 1) * p
            low = math.floor(h)
            v = []
            for rank in (low, min(low + 1, n - 1)):
                r = bisect_right(starts[c], rank) - 1
                v.append(picked[i, r, rank - starts[c][r]])
            values.append(v[0] if h == low else v[0] + (v[1] - v[0]) * (h - low))
        out[c] = values
    return out


def _ranks(n: int, probs: list[float]) -> set[int]:
    lows = {math.floor((n - 1) * p) for p in probs}
    return lows | {min(r + 1, n - 1) for r in lows}


def _range_starts(ranged: DataFrame, splits: Splits) -> dict[str, list[int]]:
    """Rank of the first value of each range."""
    starts = {c: [0] for c in splits.cuts}
    split = [c for c in splits.cuts if splits.cuts[c]]
    if split:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull(), F.col("_range_" + c)).alias("r"))
            for i, c in enumerate(split)
        ]))
        counts = ranged.select(pairs.alias("p")).where("p.r is not null").groupBy("p.c", "p.r").count().collect()
        per = {(row["c"], row["r"]): row["count"] for row in counts}
        for i, c in enumerate(split):
            sizes = [per.get((i, r), 0) for r in range(len(splits.cuts[c]) + 1)]
            starts[c] = [0, *accumulate(sizes)][: len(sizes)]
    return starts


def _values_at(ranged: DataFrame, columns: list[str], wanted: dict[tuple[int, int], set[int]]) -> dict:
    """Value at each wanted rank; keys are (column number, range, rank in the range)."""
    entries = []
    for i, c in enumerate(columns):
        hits = [r for (j, r) in wanted if j == i]
        if hits:
            test = F.col("_range_" + c).isin(hits) & F.col(c).isNotNull()
            entries.append(F.when(test, F.struct(F.lit(i).alias("c"), F.col("_range_" + c).alias("r"), F.col(c).alias("v"))))
    cells = ranged.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    per_value = cells.groupBy("e.c", "e.r", "e.v").count()
    window = W.partitionBy("c", "r").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = per_value.withColumn("upto", F.sum("count").over(window))
    targets = ranged.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.lit(r).alias("r"), F.lit(rank).cast("long").alias("rank"))
        for (i, r), ranks in wanted.items() for rank in sorted(ranks)
    ])))
    # The targets are at most two per probability and column.
    hits = ends.join(F.broadcast(targets), ["c", "r"]).where(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count"))
    )
    return {(h["c"], h["r"], h["rank"]): h["v"] for h in hits.select("c", "r", "rank", "v").collect()}
