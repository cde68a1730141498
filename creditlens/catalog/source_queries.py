"""Scans, sinks, records and row shaping."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens import schemas as S
from creditlens.catalog import sql as Q
from creditlens.catalog.registry import query
from creditlens.operators import encode as E
from creditlens.operators import shaping as B
from creditlens.operators.grading import add_grades
from creditlens.plans import preparation as P
from creditlens.session import new_path
from creditlens.sources import records as R
from creditlens.sources import tables as A
from creditlens.sources import views as V


@query("a1_catalog_scan", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
""")
def a1(spark, sf):
    V.table(spark, sf, "orders").createOrReplaceTempView("creditlens_orders")
    df = A.read_table(spark, "creditlens_orders")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


_CSV_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@query("a2_csv_scan", """
SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 10 <> 1 THEN c_name END AS c_name,
  CASE WHEN c_custkey % 10 <> 2 THEN c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 10 <> 3 THEN c_acctbal END AS c_acctbal
FROM customer
""")
def a2(spark, sf):
    k = F.col("c_custkey") % 10
    text = V.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k == 0, F.lit("NA")).when(k != 1, F.col("c_name")).alias("c_name"),
        F.when(k == 2, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(k == 3, F.lit("nan")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    path = new_path(spark, "csv")
    A.write_csv(text, path)
    return A.read_csv(spark, path, _CSV_SCHEMA)


@query("a3_stage_sink", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL
""")
def a3(spark, sf):
    path = new_path(spark, "stage")
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    A.write_stage_table(lines, path)
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("a4_literal_rows", Q.with_view("graded", """
SELECT g."Rating" AS rating, g."Total" AS reference_total, count(row_id) AS n
FROM grades g LEFT JOIN graded ON g."Rating" = graded.rating GROUP BY ALL
"""))
def a4(spark, sf):
    grades = A.literal_rows(spark, S.GRADES, S.GRADE_SCHEMA)
    counts = add_grades(V.scored(spark, sf), grades).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    names = grades.select(F.col("Rating").alias("rating"), F.col("Total").alias("reference_total"))
    return names.join(counts, "rating", "left").select("rating", "reference_total", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_PROPS = T.StructType([T.StructField("k", T.IntegerType())])


@query("a5_json_event_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS error FROM events
""")
def a5_events(spark, sf):
    return R.parse_json(V.table(spark, sf, "events").select("event_id", "props"), "props", _PROPS)


@query("a5_json_requests", Q.with_view("model_input", f"""
SELECT id_aplikasi, {", ".join(
    f"CAST(trunc({f}) AS INTEGER) AS {f}" if S.REQUEST_SCHEMA[f].dataType == T.IntegerType()
    else f"round({f}, 6) AS {f}" if f in S.NUMERIC_FEATURES else f for f in S.FEATURES
)} FROM model_input
"""))
def a5_requests(spark, sf):
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf), "id_aplikasi"), "id_aplikasi")
    requests = R.to_json_records(rows, [*S.FEATURES, S.TARGET])
    parsed = R.parse_json(requests, "record", S.REQUEST_SCHEMA).where("error is null").drop("error")
    doubles = [f for f in S.NUMERIC_FEATURES if S.REQUEST_SCHEMA[f].dataType == T.DoubleType()]
    return parsed.withColumns({f: F.round(f, 6) for f in doubles})


@query("a6_saved_encoders", Q.with_view("model_input", "SELECT id_aplikasi, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in S.CATEGORICAL_FEATURES
) + " FROM model_input"))
def a6(spark, sf):
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf), "id_aplikasi"), "id_aplikasi")
    columns = list(S.CATEGORICAL_FEATURES)
    path = new_path(spark, "encoder")
    E.fit_label_encoder(rows, columns).write().overwrite().save(path)
    return E.label_encode(PipelineModel.load(path), rows, columns).select("id_aplikasi", *columns)


@query("a7_row_cap", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def a7(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.first_rows(df, 100, F.desc("o_totalprice"), "o_orderkey")


# Row shaping ---------------------------------------------------------------------------------

_KEPT = [
    "id_aplikasi", "debitur_baru", "status_nikah", "jenis_kelamin", "kepemilikan_tempat_tinggal", "tujuan_penggunaan",
    "pendidikan", "plafond", "jangka_waktu",
]


@query("b1_drop_columns", Q.with_view("loan_raw", f"SELECT {', '.join(_KEPT)} FROM loan_raw"))
def b1(spark, sf):
    raw = V.loan_raw(spark, sf)
    return B.drop_columns(raw, [c for c in raw.columns if c not in _KEPT])


@query("b2_rename", Q.with_view("loan_raw", "SELECT id_aplikasi, debitur_baru AS debitur_lama FROM loan_raw"))
def b2(spark, sf):
    raw = V.loan_raw(spark, sf).select("id_aplikasi", "debitur_baru")
    return B.rename_columns(raw, {"debitur_baru": "debitur_lama"})


@query("b3_reorder", Q.with_view("loan_raw", """
SELECT CAST(tgl_mulai AS VARCHAR) AS tgl_mulai, id_aplikasi, plafond, kolektibilitas FROM loan_raw
"""))
def b3(spark, sf):
    raw = V.loan_raw(spark, sf).select(
        "id_aplikasi", "kolektibilitas", F.col("tgl_mulai").cast("string").alias("tgl_mulai"), "plafond"
    )
    return B.reorder(raw, first=["tgl_mulai"], last=["kolektibilitas"])


@query("b4_feature_list", Q.with_view("v2", "SELECT id_aplikasi, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in S.NUMERIC_FEATURES else c for c in S.FEATURES
) + " FROM v2"))
def b4(spark, sf):
    v2 = P.prepare(V.loan_raw(spark, sf), "id_aplikasi")
    features = B.feature_columns(v2, ["id_aplikasi", S.DATE_COLUMN, S.TARGET, *S.IGNORED_FEATURES])
    numbers = {c: F.round(F.col(c).cast("double"), 6) for c in features if c in S.NUMERIC_FEATURES}
    return v2.select("id_aplikasi", *features).withColumns(numbers)


@query("b5_row_filters", Q.with_view("v1", """
SELECT id_aplikasi, usia, round(ratio_pendatapan_to_angsuran, 6) AS ratio, plafond FROM v1
WHERE usia >= 16 AND ratio_pendatapan_to_angsuran >= 0 AND ratio_pendatapan_to_angsuran < 10 AND plafond <= 25000000
"""))
def b5(spark, sf):
    v1 = P.stage_ratios(P.stage_clean(V.loan_raw(spark, sf), "id_aplikasi"))
    rows = B.keep_rows(
        v1,
        B.in_range(F.col("usia"), low=S.MIN_AGE),
        B.in_range(F.col("ratio_pendatapan_to_angsuran"), low=0, below=10),
        B.in_range(F.col("plafond"), high=S.MAX_PLAFOND),
    )
    return rows.select("id_aplikasi", "usia", F.round("ratio_pendatapan_to_angsuran", 6).alias("ratio"), "plafond")


@query("b6_drop_incomplete", Q.with_view("loan_raw", """
SELECT id_aplikasi, angsuran, plafond FROM loan_raw WHERE angsuran IS NOT NULL AND plafond IS NOT NULL
"""))
def b6(spark, sf):
    rows = V.loan_raw(spark, sf).select("id_aplikasi", "angsuran", "plafond")
    return B.drop_incomplete(rows, ["angsuran", "plafond"])


@query("b7_null_profile", Q.with_view("loan_raw", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(*) AS n_rows, count({c}) < count(*) AS has_nulls FROM loan_raw"
    for c in V.LOAN_COLUMNS
)))
def b7(spark, sf):
    return B.null_profile(V.loan_raw(spark, sf))


@query("b8_cast", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_orderpriority,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus
FROM orders
""")
def b8(spark, sf):
    df = V.table(spark, sf, "orders").withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    return B.cast_columns(df, T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderpriority", T.IntegerType()),
        T.StructField("o_totalprice", T.StringType()),
        T.StructField("o_orderstatus", T.DoubleType()),
    ]))


@query("b9_append_rows", Q.with_view("loan_raw", """
SELECT id_aplikasi, plafond, jangka_waktu FROM loan_raw
UNION ALL SELECT -id_aplikasi - 1, plafond, jangka_waktu FROM loan_raw WHERE kolektibilitas > 2
"""))
def b9(spark, sf):
    raw = V.loan_raw(spark, sf)
    failed = raw.where("kolektibilitas > 2").withColumn("id_aplikasi", -F.col("id_aplikasi") - 1)
    return B.append_rows(raw.select("id_aplikasi", "plafond", "jangka_waktu"), failed)


@query("v2_model_table", Q.with_view("v2", f"""
SELECT id_aplikasi, {", ".join(
    "CAST(tgl_mulai AS VARCHAR) AS tgl_mulai" if c == "tgl_mulai" else f"round(CAST({c} AS DOUBLE), 6) AS {c}"
    if S.MODEL_TABLE_SCHEMA[c].dataType != T.StringType() else c for c in S.MODEL_TABLE_COLUMNS
)} FROM v2
"""))
def v2(spark, sf):
    df = P.prepare(V.loan_raw(spark, sf), "id_aplikasi")
    numbers = [c for c in S.MODEL_TABLE_COLUMNS if S.MODEL_TABLE_SCHEMA[c].dataType != T.StringType()]
    return df.withColumns({
        **{c: F.round(F.col(c).cast("double"), 6) for c in numbers}, "tgl_mulai": F.col("tgl_mulai").cast("string")
    })


