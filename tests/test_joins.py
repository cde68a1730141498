"""Hot keys of the loan view, and records parsed once."""

import json

from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.operators.joins import HOT_PARTS, hot_keys, join_summary
from creditlens.sources import views as V
from creditlens.sources.records import parse_json
from tests.test_stages import plan_of


def orders(spark):
    """A third of the rows has key 7, some have none."""
    return spark.range(3000).select(
        F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 90).alias("k"))


def test_a_hot_key_is_dealt(spark):
    left = orders(spark)
    right = spark.createDataFrame([(7, 1.0), (7, 5.0), (8, 2.0), (None, 9.0), (500, 3.0)], "c long, b double")
    assert [r["hot_key"] for r in hot_keys(left, "k", 500).collect()] == [7]
    got = join_summary(left, right, "k", "c", F.col("o"), hot_rows=500, b=F.max("b"), n=F.count("*"))
    want = left.join(right.groupBy("c").agg(F.max("b").alias("b"), F.count("*").alias("n")), F.col("k") == F.col("c"), "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_deals_follow_the_share(spark):
    left = orders(spark)
    counts = {r["k"]: r["count"] for r in left.where("k is not null").groupBy("k").count().collect()}
    total = sum(counts.values())
    got = {r["hot_key"]: r["deals"] for r in hot_keys(left, "k", 0).collect()}
    assert got == {k: -(-n * HOT_PARTS // total) for k, n in counts.items() if n * HOT_PARTS > total}
    assert len(got) < HOT_PARTS and hot_keys(left.limit(0), "k", 0).count() == 0


def test_unused_summaries_cost_nothing(spark, sf_dir):
    plan = plan_of(V.loan_raw(spark, sf_dir).select("id_aplikasi"))
    assert "customer" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_records_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "record string")
    plan = plan_of(parse_json(df, "record", S.REQUEST_SCHEMA))
    assert plan.count("from_json") + plan.count("JsonToStructs") <= 1 and "json_object_keys" not in plan


def test_errors_of_odd_records(spark):
    schema = S.REQUEST_SCHEMA
    texts = {
        "": "empty record", "  ": "empty record", "{}": "empty record", " { } ": "empty record", "{oops": "malformed record",
        "[]": "malformed record", "[{}]": "malformed record", "3": "malformed record", "null": "malformed record",
        '"a"': "malformed record", '{"usia": 3': "malformed record", '{"usia" 3}': "malformed record", "{": "malformed record",
        '{"other": 1}': ",".join(schema.names), json.dumps({n: None for n in schema.names}): ",".join(schema.names),
    }
    df = spark.createDataFrame(list(enumerate([None, *texts])), "i int, record string")
    got = [r["error"] for r in parse_json(df, "record", schema).orderBy("i").collect()]
    assert got == ["empty record", *texts.values()]
