"""Bucketed credit-risk reports: Kolmogorov-Smirnov, default shares, weight of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens.operators.binning import add_bucket, bucket_spine

INFINITY = float("inf")

# --- fixed values ---------------------------------------------------------------------------

MAX_KS_MARK = "<----"


def _bucket_counts(df: DataFrame, value: str, label: str, n: int, bins) -> DataFrame:
    """One row per bucket, empty ones included, with counts and the totals of all rows.

    Rows outside the edges are in no bucket but stay in the totals. Everything after the grouping
    works on at most one row per bucket.
    """
    bucketed, edges = add_bucket(df.select(value, label), value, n, bins)
    stats = bucketed.groupBy("bucket").agg(
        F.min(value).alias("low_value"),
        F.max(value).alias("high_value"),
        F.sum(F.col(label).cast("long")).alias("bad"),
        F.count(label).alias("rows"),
    )
    # Rows outside the edges arrive under bucket null; they are in the sums over everything.
    everything = W.partitionBy()
    zero = F.lit(0).cast("long")
    joined = bucket_spine(df, edges).join(stats, "bucket", "full_outer").select(
        "bucket", "lo", "hi", "low_value", "high_value",
        F.coalesce("bad", zero).alias("tot_bad"),
        (F.coalesce("rows", zero) - F.coalesce("bad", zero)).alias("tot_good"),
        F.coalesce("rows", zero).alias("total"),
        F.sum("bad").over(everything).alias("all_bad"),
        F.sum(F.col("rows") - F.col("bad")).over(everything).alias("all_good"),
    )
    return joined.where("bucket is not null")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return part / F.nullif(whole, F.lit(0))


def format_odds(good: Column, bad: Column) -> Column:
    """good : bad as text with two decimals."""
    return (
        F.when((bad == 0) & (good == 0), F.lit("nan"))
        .when(bad == 0, F.lit("inf"))
        .otherwise(F.format_string("%.2f", good / F.nullif(bad, F.lit(0))))
    )


def ks_table(df: DataFrame, score: str, label: str, n: int = 10, bins: list[float] | None = None) -> DataFrame:
    """Bad and good shares per score bucket from low to high, their running sums and the KS distance."""
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = _bucket_counts(df, score, label, n, bins).select(
        "bucket",
        F.col("low_value").alias("min_scr"),
        F.col("high_value").alias("max_scr"),
        "tot_bad", "tot_good", "total",
        share(F.col("tot_bad"), F.col("all_bad")).alias("pct_bad"),
        share(F.col("tot_good"), F.col("all_good")).alias("pct_good"),
        format_odds(F.col("tot_good"), F.col("tot_bad")).alias("odds"),
    )
    table = table.withColumns({"cum_bad": F.sum("pct_bad").over(upto), "cum_good": F.sum("pct_good").over(upto)})
    table = table.withColumn("ks", F.abs(F.bround(F.col("cum_bad") - F.col("cum_good"), 4)))
    top = F.max("ks").over(W.partitionBy())
    return table.withColumn("max_ks", F.when(F.col("ks") == top, F.lit(MAX_KS_MARK)).otherwise(F.lit("")))


def pd_table(df: DataFrame, score: str, label: str, n: int = 10, bins: list[float] | None = None) -> DataFrame:
    """Per score bucket: range, bads, rows and the share of all bads that falls into the bucket."""
    return _bucket_counts(df, score, label, n, bins).select(
        "bucket",
        F.col("low_value").alias("PD_min"),
        F.col("high_value").alias("PD_max"),
        "tot_bad", "total",
        share(F.col("tot_bad"), F.col("all_bad")).alias("pct_bad"),
    )


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b): signed infinity if one side is 0, null if both are."""
    return (
        F.when((a == 0) & (b == 0), F.lit(None).cast("double"))
        .when(a == 0, F.lit(-INFINITY))
        .when(b == 0, F.lit(INFINITY))
        .otherwise(F.log(a / F.nullif(b, F.lit(0.0))))
    )


def _woe_columns(table: DataFrame, keys: list[str], all_bad: Column, all_good: Column) -> DataFrame:
    bad, good = share(F.col("tot_bad"), all_bad), share(F.col("tot_good"), all_good)
    return table.select(
        *keys, "tot_bad", "tot_good", "total",
        bad.alias("pct_bad"), good.alias("pct_good"),
        bad.alias("distr_bad"), good.alias("distr_good"),
        (bad - good).alias("distr_margin"),
        log_ratio(bad, good).alias("WoE"),
        ((bad - good) * log_ratio(bad, good)).alias("IV"),
    )


def woe_numeric(df: DataFrame, feature: str, label: str, n: int = 10, bins: list[float] | None = None) -> DataFrame:
    """Weight of evidence and information value per bucket of a numeric feature."""
    table = _bucket_counts(df, feature, label, n, bins)
    table = table.withColumnsRenamed({"low_value": "min_val", "high_value": "max_val"})
    return _woe_columns(table, ["bucket", "lo", "hi", "min_val", "max_val"], F.col("all_bad"), F.col("all_good"))


def woe_categorical(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Weight of evidence and information value per category; null is no category but counts in the totals.

    There may be many categories, so the totals are a one-row subquery and no single-task window.
    """
    bad = F.sum(F.col(label).cast("long"))
    totals = df.agg(F.struct(bad.alias("bad"), (F.count(label) - bad).alias("good")).alias("t")).scalar()
    table = df.where(F.col(feature).isNotNull()).groupBy(feature).agg(
        bad.alias("tot_bad"), (F.count(label) - bad).alias("tot_good"), F.count(label).alias("total")
    )
    return _woe_columns(table, [feature], totals["bad"], totals["good"])


def total_iv(woe_table: DataFrame, *keys: str) -> DataFrame:
    """Sum of the information values, nulls skipped; infinite if one bucket lacks a class."""
    return woe_table.groupBy(*keys).agg(F.sum("IV").alias("iv"))
