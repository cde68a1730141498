"""Column selection, row filters, null profile, union."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def reorder(df: DataFrame, first: list[str] = (), last: list[str] = ()) -> DataFrame:
    middle = [c for c in df.columns if c not in (*first, *last)]
    return df.select(*first, *middle, *last)


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def keep_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition holds; a null condition does not hold."""
    return df.where(reduce(and_, conditions))


def in_range(c: Column, low: float | None = None, high: float | None = None, below: float | None = None) -> Column:
    """``low`` <= c <= ``high`` and c < ``below``, with the given limits only."""
    tests = []
    if low is not None:
        tests.append(c >= low)
    if high is not None:
        tests.append(c <= high)
    if below is not None:
        tests.append(c < below)
    return reduce(and_, tests)


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every column; NaN is none. A column that is never either is not computed for it."""
    complete = {f.name for f in df.schema if not f.nullable and not isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    doubtful = [c for c in columns if c not in complete]
    return df.na.drop(subset=doubtful) if doubtful else df


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: non-null count, row count, and whether the column has gaps."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot("n_rows", df.columns, "column_name", "n_values").select(
        "column_name", "n_values", "n_rows", (F.col("n_values") < F.col("n_rows")).alias("has_nulls")
    )


def cast_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types and in its order; a failed cast is null."""
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of ``extra`` below ``df``, aligned by name; further columns of ``extra`` are left out."""
    return df.unionByName(extra.select(df.columns))
