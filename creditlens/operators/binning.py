"""Bucket assignment. The rules differ in which end is closed, so each has its own expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlens.functions.labels import choose
from creditlens.functions.numbers import missing_to_null
from creditlens.operators.ranges import exact_quantiles

# --- fixed values ---------------------------------------------------------------------------

FIFTHS = [0.0, 0.2, 0.4, 0.6, 0.8]


def _count_true(tests: list[Column]) -> Column:
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def fixed_bucket(c: Column, edges: list[float]) -> Column:
    """Bucket 1.. of (low, high]; null at or below the first edge and above the last."""
    inside = (c > float(edges[0])) & (c <= float(edges[-1]))
    return F.when(inside, 1 + _count_true([c > float(e) for e in edges[1:-1]]))


def quantile_edges(df: DataFrame, value: str, n: int) -> list[float]:
    """Edges 0/n .. n/n; an error if two edges coincide."""
    edges = exact_quantiles(df, [value], [i / n for i in range(n + 1)])[value]
    if None in edges:
        raise ValueError(f"no values to bin in {value}")
    if len(set(edges)) < len(edges):
        raise ValueError(f"bucket edges of {value} are not unique: {edges}")
    return edges


def quantile_bucket(c: Column, edges: list[float]) -> Column:
    """Bucket 1..n, right-closed, with the lowest value included; equal values share a bucket."""
    return F.when(c.isNotNull(), 1 + _count_true([c > e for e in edges[1:-1]]))


def fifth_bucket(c: Column, edges: list[float]) -> Column:
    """Bucket 1..5 by the 0/20/40/60/80 percent points; a value on a point belongs to the later bucket."""
    return F.when(c.isNotNull(), _count_true([c >= e for e in edges]))


def continuous_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns holding at least one fractional number."""
    flags = df.agg(*[F.max(F.col(c) != F.floor(c)).alias(c) for c in columns]).first()
    return [c for c in columns if flags[c]]


def discretise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace continuous columns by their fifth; whole-number columns stay."""
    numeric = df.withColumns({c: missing_to_null(F.col(c)) for c in columns})
    cut = continuous_columns(numeric, columns)
    points = exact_quantiles(numeric, cut, FIFTHS)
    return numeric.withColumns({c: fifth_bucket(F.col(c), points[c]).cast("double") for c in cut})


def add_bucket(df: DataFrame, value: str, n: int = 10, bins: list[float] | None = None, out: str = "bucket"):
    """Add the bucket column; returns the frame and the edges. ``bins`` gives fixed edges, else ``n`` quantiles."""
    if bins is not None:
        edges = [float(b) for b in bins]
        return df.withColumn(out, fixed_bucket(F.col(value), edges)), edges
    numeric = df.withColumn(value, missing_to_null(F.col(value)))
    edges = quantile_edges(numeric, value, n)
    return numeric.withColumn(out, quantile_bucket(F.col(value), edges)), edges


def bucket_spine(df: DataFrame, edges: list[float], out: str = "bucket") -> DataFrame:
    """One row per bucket with its edges, whether any value falls into it or not."""
    n = len(edges) - 1
    ids = df.sparkSession.range(1, n + 1, 1, 1).select(F.col("id").cast("int").alias(out))
    return ids.select(
        out,
        choose([(F.col(out) == i + 1, F.lit(edges[i])) for i in range(n)]).alias("lo"),
        choose([(F.col(out) == i + 1, F.lit(edges[i + 1])) for i in range(n)]).alias("hi"),
    )
