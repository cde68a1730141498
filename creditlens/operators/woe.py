"""Weight of evidence with limits, for many features in one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.operators.binning import discretise
from creditlens.session import MAX_SMALL_ROWS

# --- fixed values ---------------------------------------------------------------------------

WOE_MIN = -20.0
WOE_MAX = 20.0


def event_counts(df: DataFrame, label: str, event=1) -> DataFrame:
    """Events, other rows and the number of distinct labels."""
    hits = F.count_if(F.col(label) == event)
    return df.agg(
        hits.alias("event_count"),
        (F.count(F.lit(1)) - hits).alias("non_event_count"),
        F.count_distinct(label).alias("n_labels"),
    )


def check_binary(df: DataFrame, label: str) -> None:
    """Error unless the label has at most two values."""
    if len(df.select(label).distinct().limit(3).collect()) > 2:
        raise ValueError("label must be binary")


def _limited_woe(counts: DataFrame, df: DataFrame, label: str, event, low: float, high: float) -> DataFrame:
    hits = F.count_if(F.col(label) == event)
    totals = df.agg(F.struct(hits.alias("yes"), (F.count(F.lit(1)) - hits).alias("no")).alias("t")).scalar()
    yes = F.col("event_count") / totals["yes"]
    no = F.col("non_event_count") / totals["no"]
    woe = (
        F.when(F.col("event_count") == 0, F.lit(float(low)))
        .when(F.col("non_event_count") == 0, F.lit(float(high)))
        .otherwise(F.log(yes / F.nullif(no, F.lit(0.0))))
    )
    return counts.withColumns({"woe": woe, "iv": (yes - no) * woe})


def woe_single(df: DataFrame, feature: str, label: str, event=1, low: float = WOE_MIN, high: float = WOE_MAX) -> DataFrame:
    """WoE and IV part per value of one feature: ``low`` without any event, ``high`` with events only."""
    hits = F.count_if(F.col(label) == event)
    counts = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("value")).agg(
        hits.alias("event_count"), (F.count(F.lit(1)) - hits).alias("non_event_count")
    )
    return _limited_woe(counts, df, label, event, low, high)


def woe_table(
    df: DataFrame, features: list[str], label: str, event=1, low: float = WOE_MIN, high: float = WOE_MAX
) -> DataFrame:
    """``woe_single`` of all numeric features, continuous ones cut into fifths first.

    Long table (feature, value, counts, woe, iv) from a single grouping.
    """
    check_binary(df, label)
    cut = discretise(df.select(label, *features), features)
    hits = F.count_if(F.col(label) == event)
    cells = cut.unpivot(label, features, "feature", "value").where("value is not null")
    counts = cells.groupBy("feature", "value").agg(
        hits.alias("event_count"), (F.count(F.lit(1)) - hits).alias("non_event_count")
    )
    return _limited_woe(counts, df, label, event, low, high)


def information_values(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.sum("iv").alias("iv"))


def woe_replace(df: DataFrame, features: list[str], table: DataFrame) -> DataFrame:
    """Replace each value by its weight of evidence; a value the table does not know is kept.

    ``table`` is best a written one: its size per feature is counted to choose between a map-side
    join and an ordinary one.
    """
    sizes = {r["feature"]: r["count"] for r in table.groupBy("feature").count().collect()}
    unknown = set(features) - set(sizes)
    if unknown:
        raise ValueError(f"no weights of evidence for {sorted(unknown)}")
    out = df
    for f in features:
        lookup = table.where(F.col("feature") == f).select(F.col("value").alias("_value"), F.col("woe").alias("_woe"))
        if sizes[f] <= MAX_SMALL_ROWS:
            lookup = F.broadcast(lookup)
        out = out.join(lookup, F.col(f).cast("double") == F.col("_value"), "left").select(
            *[F.coalesce("_woe", F.col(f).cast("double")).alias(f) if c == f else c for c in out.columns]
        )
    return out


def combined_iv(df: DataFrame, features: list[str], label: str, event=1, sep: str = "", **limits) -> DataFrame:
    """WoE of the combination of features, keyed by their texts joined by ``sep``.

    With the default, values such as ("1", "11") and ("11", "1") share a key; give a separator to
    tell them apart.
    """
    check_binary(df, label)
    key = F.concat_ws(sep, *[F.coalesce(F.col(f).cast("string"), F.lit("nan")) for f in features])
    return woe_single(df.select(label, key.alias("value")), "value", label, event, **limits)
