"""Missing, odd and broken values: what each operator makes of them."""

import pytest
from pyspark.sql import functions as F

from creditlens.functions.labels import strip
from creditlens.functions.numbers import parse_day_first
from creditlens.operators import balance, explore


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_neighbour_search_refuses_gaps(spark, bad):
    rows = [(i, 1, float(i), 0.0) for i in range(20)] + [(99, 1, bad, 1.0)]
    df = spark.createDataFrame(rows, "id long, target int, x double, y double")
    with pytest.raises(ValueError, match="'x': 1"):
        balance.nearest_neighbours(df, "id", ["x", "y"]).count()


def test_synthetic_rows_are_all_made_and_differ(spark):
    rows = [(i * 7919, int(i % 10 == 0), float(i % 17), float(i % 23)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, target int, x double, y double")
    made = balance.synthetic_minority(df, "id", ["x", "y"], "target", share=0.4)
    wanted = int(1800 * (0.4 / 0.6)) - 200
    assert made.count() == wanted
    assert made.select("u").distinct().count() > 0.99 * wanted


def test_third_of_rows_equal(spark):
    rows = [(i, 1, 5.0, 5.0) for i in range(100)] + [(100 + i, 1, float(i), float(-i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, target int, x double, y double")
    found = balance.nearest_neighbours(df, "id", ["x", "y"])
    assert found.groupBy("id").count().filter("count = 5").count() == 300


def test_null_cluster_is_counted(spark):
    df = spark.createDataFrame([(0.1, None), (0.2, None), (0.9, 1)], "pd double, cluster int")
    got = {r.cluster: r.n for r in explore.histogram_shared(df, "pd", "cluster").groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    assert got == {None: 2, 1: 1}


def test_blanks_of_unicode_are_stripped(spark):
    texts = [" SD 　", "SD", " \tSD \x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")).alias("t"))
    assert {r.t for r in df.collect()} == {"SD"} == {t.strip() for t in texts}


def test_malformed_date_is_null(spark):
    df = spark.createDataFrame([("31-12-2020",), ("2020",), ("99-99-9999",), (None,)], "t string")
    assert [str(r.d) for r in df.select(parse_day_first(F.col("t")).alias("d")).collect()] == ["2020-12-31", "None", "None", "None"]
