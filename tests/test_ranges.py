"""Exact quantiles and running totals, with the value range cut into slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditlens.operators import binning as B
from creditlens.operators.ranges import exact_quantiles, find_splits, running_totals

RNG = np.random.default_rng(5)
# A third of the rows share one value.
SKEWED = np.concatenate([np.full(400, 7.5), RNG.normal(5, 3, 500), RNG.integers(0, 4, 300)]).astype(float)
SLICES = {"rows_per_range": 50, "max_ranges": 16}


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(v), int(RNG.random() < 0.3)) for i, v in enumerate(SKEWED)]
    return spark.createDataFrame(rows, "id long, x double, bad int").repartition(5).cache()


@pytest.mark.parametrize("options", [{}, SLICES])
def test_quantiles_match_numpy(data, options):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    with_gaps = data.withColumn("y", F.when(F.col("id") % 3 == 0, F.col("id").cast("double"))).withColumn(
        "empty", F.lit(None).cast("double"))
    got = exact_quantiles(with_gaps, ["x", "y", "empty"], probs, **options)
    assert got["x"] == pytest.approx(np.quantile(SKEWED, probs))
    assert got["y"] == pytest.approx(np.quantile(np.arange(0, len(SKEWED), 3), probs))
    assert got["empty"] == [None] * len(probs)


def test_slices_are_used(data):
    assert len(find_splits(data, ["x"], **SLICES).cuts["x"]) > 3


@pytest.mark.parametrize("options", [{}, SLICES])
@pytest.mark.parametrize("partitions", [1, 16])
def test_running_totals(data, options, partitions):
    got = running_totals(data.repartition(partitions), "x", {"n": F.lit(1), "bad": F.col("bad")}, **options).toPandas()
    got = got.sort_values("x").reset_index(drop=True)
    pdf = data.toPandas().groupby("x").agg(n=("id", "size"), bad=("bad", "sum")).reset_index()
    assert got["x"].tolist() == pdf["x"].tolist()
    for c in ("n", "bad"):
        assert got[c].tolist() == pdf[c].tolist()
        assert got[f"{c}_before"].tolist() == (pdf[c].cumsum() - pdf[c]).tolist()


def test_quantile_bucket_matches_pandas(spark):
    x = RNG.normal(0, 1, 501).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    bucketed, _ = B.add_bucket(df, "x", 10)
    got = dict(bucketed.distinct().collect())
    want = dict(zip(x, pd.qcut(pd.Series(x), 10, labels=np.arange(10) + 1)))
    assert got == {float(k): int(v) for k, v in want.items()}


def test_quantile_bucket_refuses_equal_edges(data):
    with pytest.raises(ValueError, match="not unique"):
        B.quantile_edges(data, "x", 10)


def test_fixed_bucket_matches_pandas(spark):
    edges = [0, 12, 18, 24]
    x = [-1.0, 0.0, 0.5, 12.0, 12.5, 18.0, 24.0, 24.5]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = {r["x"]: r["bucket"] for r in B.add_bucket(df, "x", bins=edges)[0].collect()}
    codes = pd.cut(x, bins=edges, labels=False)
    assert got == {v: (None if np.isnan(c) else int(c) + 1) for v, c in zip(x, codes)}


def test_fifths_give_points_to_the_later_bucket(spark):
    x = [float(i) for i in range(11)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    points = exact_quantiles(df, ["x"], B.FIFTHS)["x"]
    got = [r["b"] for r in df.select("x", B.fifth_bucket(F.col("x"), points).alias("b")).orderBy("x").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]


def test_only_fractional_columns_are_cut(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.0)], "whole double, part double")
    assert B.continuous_columns(df, ["whole", "part"]) == ["part"]
    assert [r["whole"] for r in B.discretise(df, ["whole", "part"]).orderBy("whole").collect()] == [1.0, 2.0, 3.0]
