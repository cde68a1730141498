"""Sources, imputation, the stages, and the plans they lead to."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens import schemas as S
from creditlens.operators import impute as I
from creditlens.operators import shaping as B
from creditlens.operators.explore import sample_rows, sample_share
from creditlens.plans import preparation as P
from creditlens.session import compiled_methods, new_path
from creditlens.sources import records as R
from creditlens.sources import tables as A
from creditlens.sources import views as V


def test_csv_null_words(spark):
    path = new_path(spark, "csv")
    rows = [("1", "a", "2.5"), ("2", "NA", "nan"), ("3", "", "n/a"), ("4", "x,\"y\"", "-1"), ("null", "NaN", "inf?")]
    A.write_csv(spark.createDataFrame(rows, "i string, t string, x string"), path)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("x", T.DoubleType())])
    got = {r["i"]: (r["t"], r["x"]) for r in A.read_csv(spark, path, schema).collect()}
    assert got == {1: ("a", 2.5), 2: (None, None), 3: (None, None), 4: ('x,"y"', -1.0), None: (None, None)}


def test_catalog_table(spark, sf_dir):
    V.table(spark, sf_dir, "nation").createOrReplaceTempView("some_table")
    assert A.read_table(spark, "some_table").count() == 25


def test_json_casts(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("t", T.StringType())])
    texts = ['{"n": 3.0, "x": "2", "t": 5, "z": 1}', '{"n": 1, "x": 1}', '{"n": "a", "x": 1, "t": ""}', "[]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    got = [tuple(r)[1:] for r in R.parse_json(df, "r", schema).orderBy("i").collect()]
    assert got[0] == (3, 2.0, "5", None)
    assert [g[3] for g in got] == [None, "t", "n", "malformed record", "empty record"]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, b string")
    got = {r["column_name"]: (r["n_values"], r["has_nulls"]) for r in B.null_profile(df).collect()}
    assert got == {"a": (3, False), "b": (1, True)}


def test_row_filters_drop_null(spark):
    df = spark.createDataFrame([(15.0,), (16.0,), (None,), (30.0,)], "x double")
    assert [r[0] for r in B.keep_rows(df, B.in_range(F.col("x"), low=16, below=30)).collect()] == [16.0]


def test_append_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("y", 9.0, 2)], "t string, more double, i int")
    assert sorted(B.append_rows(a, b).collect()) == [(1, "x"), (2, "y")]


def test_fill_values(spark):
    rows = [("a", 1.0, 4.0, None), ("b", None, None, None), ("b", 3.0, 9.0, None), ("a", 4.0, None, None), (None, 8.0, 5.0, None)]
    df = spark.createDataFrame(rows, "t string, x double, m double, empty string")
    fill = I.fit_fill_values(df, mean_columns=["m"])
    assert fill.values == {"t": "a", "x": 3.5, "m": 6.0, "empty": None}
    got = fill.apply(df).collect()
    assert [r["t"] for r in got] == ["a", "b", "b", "a", "a"]
    assert [r["empty"] for r in got] == [None] * 5


def test_fill_statistics_do_not_depend_on_partitions(spark, sf_dir):
    rows = P.clean(V.loan_raw(spark, sf_dir))
    a, b = (P.fit_imputation(rows.repartition(n)).values for n in (1, 16))
    assert a == b


def test_stages(spark, sf_dir):
    raw = V.loan_raw(spark, sf_dir)
    v0 = P.stage_clean(raw)
    assert v0.columns[0] == "tgl_mulai" and v0.columns[-1] == "target"
    gaps = {r["column_name"] for r in B.null_profile(v0).where("has_nulls").collect()}
    assert gaps <= {"tgl_mulai", "target"}
    v1 = P.stage_ratios(v0)
    v2 = P.stage_model_table(v1, extra=v1.limit(0))
    assert v2.columns == S.MODEL_TABLE_COLUMNS
    assert v2.where("usia < 16 or ratio_pendatapan_to_angsuran < 0 or ratio_pendatapan_to_angsuran is null").count() == 0
    assert {r[0] for r in v2.select("pendidikan").distinct().collect()} <= {"TidakSekolah", "SD/SMP/SMU/SMK", "Akademi/Diploma", "S1/S2/S3"}
    assert P.model_input(v2).columns == [*S.FEATURES, "target"]


def test_samples(spark):
    ids = spark.range(1000)
    assert sample_rows(ids, "id", 100, 3).distinct().count() == 100
    assert sample_rows(ids, "id", 100, 3).collect() == sample_rows(ids.repartition(9), "id", 100, 3).collect()
    assert 150 < sample_share(ids, "id", 0.2, 3).count() < 250


# Plans ---------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_joins_go(spark, sf_dir):
    plan = plan_of(V.loan_raw(spark, sf_dir).select("id_aplikasi", "plafond"))
    assert "Join" not in plan and "lineitem" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in plan


@pytest.mark.parametrize("prefix", ["c", "d", "e", "f", "g", "s4"])
def test_no_python_in_the_plans(spark, sf_dir, prefix):
    from creditlens.catalog import QUERIES

    heavy = {"g3_g4_information_values", "g6_information_values", "g7_woe_replace"}
    names = [n for n in QUERIES if n.startswith(prefix) and n[len(prefix)] in "_0123456789" and n not in heavy]
    for name in names[:6] if prefix in "cdeg" else names:
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "Python" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_incomplete_rows_are_found_without_columns_that_are_never_null(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0, 1.0), (2, None, 1.0, 1.0), (3, "a", None, 1.0), (4, "a", nan, 1.0), (5, "a", float("inf"), -1.0), (6, "a", 1.0, nan), (7, " ", float("-inf"), 0.0)]
    df = spark.createDataFrame(rows, "i int, t string, x double, f float").repartition(2)
    df = df.withColumn("n", F.when(F.trim("t") == "a", F.lit("A")).otherwise(F.lit("")))
    got = B.drop_incomplete(df, ["n", "t", "x", "f"])
    assert {r["i"] for r in got.collect()} == {r["i"] for r in df.na.drop(subset=["n", "t", "x", "f"]).collect()} == {1, 5, 7}
    conditions = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert conditions and not any("trim" in line for line in conditions)
    whole = df.select("n", F.lit(nan).alias("x"))
    assert B.drop_incomplete(whole, ["n"]).count() == 7 and B.drop_incomplete(whole, ["n", "x"]).count() == 0


def test_cleaning_parses_a_date_and_strips_a_text_once(spark, sf_dir):
    cleaned = P.clean(V.loan_raw(spark, sf_dir), "id_aplikasi")
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    # Two dates, and the date of birth once more in the filter of complete rows; education, and the end of the job.
    assert plan.count("gettimestamp(") == 3
    assert plan.count("trim(") == 2


def test_wide_expressions_are_compiled_in_any_session(spark, sf_dir):
    other = spark.newSession()
    for limit, used in (("65535", "8000"), ("5000", "5000")):
        other.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
        with pytest.raises(KeyError), compiled_methods(other):
            assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == used
            raise KeyError
        assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    found = []
    seen = P.write_stage
    try:
        P.write_stage = lambda df, name: found.append(df.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit")) or seen(df, name)
        other.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        P.prepare(V.loan_raw(other, sf_dir), "id_aplikasi")
    finally:
        P.write_stage = seen
    assert found == ["8000"]
