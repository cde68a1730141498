"""Exploration tables: default rates, class counts, samples, histograms."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens.functions.hashing import row_hash, unit_hash
from creditlens.functions.labels import choose
from creditlens.functions.numbers import missing_to_null
from creditlens.operators.ranges import exact_quantiles
from creditlens.session import small_rows


def default_rate(df: DataFrame, feature: str, target: str = "target") -> DataFrame:
    """Percentage of defaults per category, categories without a default left out, ascending."""
    bad = F.count_if(F.col(target) == 1)
    return (
        df.where(F.col(feature).isNotNull())
        .groupBy(feature)
        .agg(bad.alias("_bad"), (bad * 100.0 / F.nullif(F.count(target), F.lit(0))).alias("percentage"))
        .where("_bad > 0")
        .drop("_bad")
        .orderBy("percentage", feature)
    )


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def sample_share(df: DataFrame, row_id: str, share: float, seed: int = 0) -> DataFrame:
    """Random sample without replacement of about ``share`` of the rows; no shuffle."""
    return df.where(unit_hash(F.col(row_id), seed) < share)


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """Random sample of exactly ``n`` rows without replacement, all rows if there are no more; ``row_id`` tells them apart.

    The rows of the ``n`` smallest (hash, id) are taken, null ids first. Two counts, by the upper bits of the hash and of the hashes with the upper bits
    that matter, find the hash of the last of them, so no task gathers the sample. Only of the rows that share this one hash (about one
    in 2^30) the smallest ids are ranked. The sample comes in random order, by a sort of its rows over all tasks.
    """
    draw = F.coalesce(row_hash(F.col(row_id), seed), F.lit(-1).cast("long"))
    upper = F.shiftright(draw, 16)
    part, before = _slice_of(df, upper, n, 0)
    if part is None:
        return df.orderBy(draw, row_id) if n > 0 else df.limit(0)
    last, before = _slice_of(df.where(upper == part), draw, n, before)
    rank, hash_of = "_sample_rank", F.lit(last).cast("long")
    tied = df.where(draw == hash_of).withColumn(rank, F.row_number().over(W.partitionBy(draw).orderBy(row_id)))
    return df.where(draw < hash_of).unionByName(tied.where(F.col(rank) <= n - before).drop(rank)).orderBy(draw, row_id)


def _slice_of(df: DataFrame, key: Column, n: int, before: int) -> tuple[int | None, int]:
    """The key (one of at most 2^16) at which the rows in its order come to ``n``, and the number of rows before it; ``before`` rows precede all."""
    if n > 0:
        for row in sorted(df.groupBy(key.alias("key")).count().collect()):
            if before + row["count"] >= n:
                return row["key"], before
            before += row["count"]
    return None, before


def shuffled(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """All rows in random order."""
    return df.orderBy(row_hash(F.col(row_id), seed), row_id)


def equal_bin(x: Column, low: Column, high: Column, n: Column) -> Column:
    """Bin 0..n-1 of equal width over [low, high], last bin closed, decided by the edges low + i * width."""
    width = (high - low) / n
    first = F.greatest(F.lit(0), F.least(F.floor((x - low) / width), n - 1)).cast("long")
    moved = (
        F.when(x < low + first * width, first - 1)
        .when((first + 1 < n) & (x >= low + (first + 1) * width), first + 1)
        .otherwise(first)
    )
    return F.when(width == 0, n.cast("long") - 1).otherwise(moved)


def histogram(df: DataFrame, value: str, chunk: int = 1000, by: str | None = None) -> DataFrame:
    """Counts in ceil(sqrt(lines)) equal bins, empty bins included; lines are the rows rounded up to
    a multiple of ``chunk``. With ``by``, one histogram per class, each over its own range."""
    lines = F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))) * chunk
    return _histogram(df, value, by, F.ceil(F.sqrt(lines)))


def histogram_shared(df: DataFrame, value: str, cluster: str, bins: int = 500) -> DataFrame:
    """Counts per cluster in ``bins`` bins over the range of all rows, empty bins included."""
    x = missing_to_null(F.col(value))
    data = df.select(F.col(cluster).alias(cluster), x.alias("_x")).where("_x is not null")
    limits = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("s")).scalar()
    lo, hi, n = limits["lo"], limits["hi"], F.lit(bins).cast("long")
    counts = data.groupBy(cluster, equal_bin(F.col("_x"), lo, hi, n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _with_empty_bins(
        counts, [cluster], counts.groupBy(cluster).agg(F.max("bin")).select(cluster).withColumns(
            {"lo": lo, "hi": hi, "n_bins": n}
        )
    )


def class_density(df: DataFrame, value: str, target: str = "target", max_bins: int = 50) -> DataFrame:
    """Density of a value per class, over the class's own range.

    The bin width is 2 * IQR / n^(1/3), with at most ``max_bins`` bins.
    """
    x = missing_to_null(F.col(value))
    data = df.select(F.col(target).alias(target), x.alias("_x")).where("_x is not null")
    classes = sorted(
        r[target] for r in data.groupBy(target).agg(F.count("_x")).limit(3).collect() if r[target] is not None
    )
    if len(classes) > 2:
        raise ValueError("the class must be binary")
    # One column per class, so that one pass serves both.
    per_class = data.select([F.when(F.col(target) == k, F.col("_x")).alias(f"c{k}") for k in classes])
    quartiles = exact_quantiles(per_class, per_class.columns, [0.25, 0.75])
    iqr = F.lit(None).cast("double")
    for k in classes:
        low, high = quartiles[f"c{k}"]
        iqr = F.when(F.col(target) == k, F.lit(high - low)).otherwise(iqr)
    n = F.count(F.lit(1))
    width = 2 * iqr / F.cbrt(n.cast("double"))
    wanted = F.when(width > 0, F.ceil((F.max("_x") - F.min("_x")) / width)).otherwise(F.floor(F.sqrt(n)))
    hist = _histogram(data, "_x", target, F.greatest(F.least(wanted, F.lit(max_bins)), F.lit(1)))
    size = F.sum("n").over(W.partitionBy(target))
    return hist.withColumn("density", F.col("n") / (size * (F.col("hi") - F.col("lo"))))


def _histogram(df: DataFrame, value: str, by: str | None, bins: Column) -> DataFrame:
    """Histogram of all rows or of each class.

    The few classes and their limits are read first and used as literals: a join on the class would
    send all rows to as many tasks as there are classes.
    """
    keys = [by] if by else []
    data = df.select(*keys, missing_to_null(F.col(value)).alias("_x")).where(F.col("_x").isNotNull())
    if by:
        data = data.where(F.col(by).isNotNull())
    limits = data.groupBy(*keys).agg(
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), bins.cast("long").alias("n_bins")
    )
    rows = [r for r in small_rows(limits, "class limits") if r["n_bins"]]
    bin_ = choose([
        (F.col(by) == r[by] if by else F.lit(True), equal_bin(F.col("_x"), F.lit(r["lo"]), F.lit(r["hi"]), F.lit(r["n_bins"])))
        for r in rows
    ]) if rows else F.lit(None).cast("long")
    counts = data.select(*keys, bin_.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return _with_empty_bins(counts, keys, df.sparkSession.createDataFrame(rows, limits.schema))


def _with_empty_bins(counts: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    spine = limits.where("n_bins > 0").select(
        *keys, "lo", "hi", "n_bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin")
    )
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    counts = counts.withColumnsRenamed({k: f"_{k}" for k in [*keys, "bin"]})
    # A null class is a class like the others.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "bin"]])
    return spine.join(counts, same, "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") + 1 == F.col("n_bins"), F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def edge_builder(df: DataFrame, value: str, steps: int = 10, last: float = 1.0) -> DataFrame:
    """Edges from the minimum in ``steps`` equal steps, the maximum excluded, then ``last``."""
    x = missing_to_null(F.col(value))
    limits = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / steps
    whole = F.ceil((F.col("hi") - F.col("lo")) / step).cast("int")
    edges = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.col("lo") + i * step)
    return limits.select(F.posexplode(F.concat(edges, F.array(F.lit(last)))).alias("position", "edge"))
