"""Mixing sources to target weights.

Words are summed per source, each source gets a target by weight, and a document is emitted floor(rate) times plus one
more time with the probability of the fraction, decided by a hash of its id. So every decision is local to a row, reruns
agree, and the only thing that is gathered is one row per source.

Edge cases: a null text has 0 words; a null source is a source of its own, listed last; rows with equal ids get equal
draws, a null id counts as the word "null"; without any word all targets are 0; an empty table gives an empty result.
Columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlens.llm.text import word_count
from creditlens.session import write_stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"


def draw(row_id: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) from the first 52 bits of the MD5 of seed and id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Targets share the sum of all sizes by weight, weights being dealt in turn to the sources in the order of their
    names. Sources that would exceed ``most`` times their size stop there and the excess is shared again; in the order of
    size per weight the stopped ones come first, so running sums give the share that ends this. The windows
    read one row per source, not documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int"))
    fill = F.col("source_size") / F.col("weight")
    ahead = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("fill", fill)
        .withColumn("size_ahead", F.coalesce(F.sum("source_size").over(ahead), F.lit(0).cast("long")))
        .withColumn("weight_ahead", F.coalesce(F.sum("weight").over(ahead), F.lit(0).cast("long")))
        .withColumn("size_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weight_all", F.sum("weight").over(Window.partitionBy()))
        .withColumn("share", (F.col("size_all") - most * F.col("size_ahead")) / (F.col("weight_all") - F.col("weight_ahead")))
        .withColumn("fits", F.col("share") * F.col("weight") <= most * F.col("source_size"))
    )
    # The first source that fits ends it: all from there on get its share by weight.
    here = F.struct("fill", F.col("source").isNull().alias("no_name"), "source")
    whole_table = Window.partitionBy()
    first = F.min(F.when(F.col("fits"), F.struct(here.alias("place"), F.col("share").alias("share")))).over(whole_table)
    return ranked.withColumn("first_fit", first).select(
        "source", "source_size",
        F.when(here >= F.col("first_fit.place"), F.col("first_fit.share") * F.col("weight"))
        .otherwise((most * F.col("source_size")).cast("double")).alias("target"),
    )


def with_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the row)."""
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col(text)))
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    # Written, so that the planner knows its size and broadcasts it only if it is small.
    targets = write_stage(source_targets(totals), "targets").withColumnRenamed("source", "named_source")
    joined = docs.join(targets, docs[source].eqNullSafe(targets["named_source"]), "left").drop("named_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_REPEATS)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + (draw(F.col(row_id), seed) < rate - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with their own columns only, each as often as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[F.col(c).alias(f"mix_{c}") for c in (text, row_id, source)])
    taken = with_copies(rows, f"mix_{text}", f"mix_{row_id}", f"mix_{source}", seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
