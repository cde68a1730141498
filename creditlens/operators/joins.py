"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above one part in HOT_PARTS of all rows and above HOT_ROWS rows; it is then dealt to up to HOT_PARTS tasks.
HOT_PARTS = 1000
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(hot_key, deals) of the keys with a large share of the rows; fewer than ``HOT_PARTS`` rows, whatever the size of ``df``."""
    total = df.agg(F.count(key)).scalar()
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") > hot_rows) & (F.col("n") * HOT_PARTS > total)).select(
        "hot_key", F.ceil(F.col("n") * HOT_PARTS / total).cast("int").alias("deals")
    )


def join_summary(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: Column, hot_rows: int = HOT_ROWS, **values: Column
) -> DataFrame:
    """Left join to the aggregates ``values`` of ``right`` per key; a hot key of ``left`` is dealt by the number ``spread``.

    The aggregates of a hot key are repeated once per deal. Rows without a key match nothing and are dealt as well. Both joins are outer
    joins to unique keys, so Catalyst drops them if no value is used.
    """
    # The number of hot keys is below HOT_PARTS by their definition, hence the broadcasts.
    hot = F.broadcast(hot_keys(left, left_key, hot_rows))
    deal = F.when(F.col(left_key).isNull(), F.pmod(spread, F.lit(HOT_PARTS))).otherwise(F.pmod(spread, F.coalesce("deals", F.lit(1))))
    dealt = left.join(hot, F.col(left_key) == F.col("hot_key"), "left").withColumn("left_deal", deal.cast("int")).drop("hot_key", "deals")
    repeated = right.join(hot, F.col(right_key) == F.col("hot_key"), "left").withColumn(
        "right_deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
    summary = repeated.groupBy(right_key, "right_deal").agg(*[v.alias(n) for n, v in values.items()])
    same = (F.col(left_key) == F.col(right_key)) & (F.col("left_deal") == F.col("right_deal"))
    return dealt.join(summary, same, "left").drop("left_deal", "right_deal")
