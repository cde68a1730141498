"""Filling of missing values from the table's own statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens.operators.ranges import exact_quantiles
from creditlens.session import small_rows


@dataclass
class FillValues:
    """One fill value per column with gaps; a column without any value has none."""

    values: dict[str, object] = field(default_factory=dict)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per column: its text or its number, or neither."""
        rows = [
            (name, value if isinstance(value, str) else None, float(value) if value is not None and not isinstance(value, str) else None)
            for name, value in self.values.items()
        ]
        return spark.createDataFrame(rows, "column string, text string, number double")

    @staticmethod
    def from_table(table: DataFrame) -> FillValues:
        rows = small_rows(table, "table of fill values")
        return FillValues({r["column"]: r["number"] if r["text"] is None else r["text"] for r in rows})

    def apply(self, df: DataFrame) -> DataFrame:
        filled = {}
        for name, value in self.values.items():
            if value is None:
                continue
            kind = T.StringType() if isinstance(value, str) else T.DoubleType()
            filled[name] = F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind))
        return df.withColumns(filled)


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on a tie.

    The values are counted by group, so a column with many distinct values needs no large buffer.
    """
    if not columns:
        return {}
    counts = (
        df.select([F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "feature", "value")
        .where("value is not null")
        .groupBy("feature", "value").count()
    )
    # Smallest of (-count, value): highest count first, then smallest value.
    best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("count"), F.col("value").alias("value"))).alias("best"))
    found = {r["feature"]: r["best"]["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def mean_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return FillValues({c: means[c] for c in columns}).apply(df)


def constant_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.na.fill(values)


def mode_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return FillValues(column_modes(df, columns)).apply(df)


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, columns, [0.5])
    return FillValues({c: v[0] for c, v in medians.items()}).apply(df)


def fit_fill_values(
    df: DataFrame,
    mean_columns: list[str] = (),
    constants: dict[str, object] | None = None,
    exclude: list[str] = (),
) -> FillValues:
    """Fill values for every column with gaps: means and constants as named, the mode for other
    text columns, the median for other numeric columns.

    One pass finds the columns with gaps; only those are read again.
    """
    constants = constants or {}
    types = {f.name: f.dataType for f in df.schema}
    candidates = [c for c in df.columns if c not in exclude and c not in constants]
    seen = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(c).alias(c) for c in candidates],
        *[F.avg(c).alias("_mean_" + c) for c in mean_columns],
    ).first()
    gaps = [c for c in candidates if seen[c] < seen["_n"]]
    others = [c for c in gaps if c not in mean_columns]
    texts = [c for c in others if isinstance(types[c], T.StringType)]
    numbers = [c for c in others if isinstance(types[c], T.NumericType)]
    values: dict[str, object] = dict(constants)
    values.update({c: seen["_mean_" + c] for c in gaps if c in mean_columns})
    values.update(column_modes(df, texts))
    values.update({c: v[0] for c, v in exact_quantiles(df, numbers, [0.5], counts=seen.asDict()).items()})
    return FillValues(values)
